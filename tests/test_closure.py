import glob
import os
import random

import pytest

from orbweaver.operators import closure as module
from orbweaver.operators.closure import closure
from orbweaver.operators.graph import LabeledGraph
from orbweaver.plans.grammar import Grammar, Rule
from orbweaver.plans.queries import POINTS_TO
from orbweaver.sources.files import read_grammar, read_graph

from .worklist import closed

SCHEMA = "src long, label string, dst long"


def graph(spark, edges, n=None):
    return LabeledGraph.from_dataframe(spark.createDataFrame(list(edges), SCHEMA), n)


def result(spark, edges, grammar, n=None, **options):
    return {tuple(r) for r in closure(graph(spark, edges, n), grammar, **options).edges.collect()}


def as_tuples(grammar):
    return [(r.lhs, r.rhs1, r.rhs2) for r in grammar.rules]


def test_hand_graphs(spark):
    assert result(spark, [], Grammar.of("A ::="), 3) == {(v, "A", v) for v in range(3)}
    assert result(spark, [(0, "B", 1)], Grammar.of("A ::= B")) == {(0, "B", 1), (0, "A", 1)}
    assert result(spark, [(0, "B", 1), (1, "C", 2)], Grammar.of("A ::= B C")) >= {(0, "A", 2)}
    assert result(spark, [(0, "B", 1), (0, "B", 1)], Grammar([])) == {(0, "B", 1)}
    assert result(spark, [(0, "zz", 1)], Grammar.of("A ::= B")) == {(0, "zz", 1)}
    cycle = [(0, "n", 1), (1, "n", 2), (2, "n", 3), (3, "n", 1), (3, "n", 4)]
    assert sum(e[1] == "P" for e in result(spark, cycle, Grammar.of("P ::= n", "P ::= P n"), rewrite=False)) == 16
    assert sum(e[1] == "P" for e in result(spark, cycle, Grammar.of("P ::= n", "P ::= P n"))) == 16
    chain = [(k, "n", k + 1) for k in range(6)]
    assert sum(e[1] == "P" for e in result(spark, chain, Grammar.of("P ::= n", "P ::= P P"))) == 21


def test_dataflow(spark):
    edges = [(0, "N", 1), (1, "e", 2), (2, "e", 3)]
    flow = result(spark, edges, Grammar.of("N ::= N e"), mode="dataflow")
    assert flow == result(spark, edges, Grammar.of("N ::= N e")) == {*edges, (0, "N", 2), (0, "N", 3)}
    for rule in ("A ::= B", "A ::= A A"):
        with pytest.raises(ValueError):
            result(spark, edges, Grammar.of(rule), mode="dataflow")
    with pytest.raises(ValueError):
        result(spark, edges, Grammar.of("N ::= N e"), mode="other")


def test_paths_of_inverses_are_made_once(spark, monkeypatch):
    """Paths along -a are those along a turned, where -a has no edges of its own; vertices of the edges are not made again."""
    calls, powers = [], module.strata._powers
    monkeypatch.setattr(module.strata, "_powers", lambda *of: calls.append(of) or powers(*of))
    edges = [(0, "d", 1), (2, "d", 3), (4, "a", 0), (4, "a", 2), (2, "a", 6), (6, "d", 7), (5, "zz", 9)]
    for more, often in (([], 1), ([(6, "-a", 4)], 2)):
        calls.clear()
        own = graph(spark, edges + more).with_inverses(["a", "d"])
        got = [tuple(r) for r in closure(own, POINTS_TO).edges.collect()]
        assert own.touched and len(calls) == often and len(got) == len(set(got))
        turned = {*edges, *more, *((d, "-" + x, s) for s, x, d in edges + more if x in "ad")}
        assert set(got) == closed(turned, as_tuples(POINTS_TO), {v for s, _, d in turned for v in (s, d)})
    both = graph(spark, edges).with_inverses(["a"])
    assert both.inverses == (("a", "-a"),) and both.with_inverses(["a"], "").inverses == ()


def test_points_to(spark):
    edges = [(0, "d", 1), (2, "d", 3), (4, "a", 0), (4, "a", 2), (1, "a", 5), (6, "d", 7)]
    edges += [(d, "-" + label, s) for s, label, d in edges]
    assert result(spark, edges, POINTS_TO, 8) == closed(edges, as_tuples(POINTS_TO), range(8))


def test_limits_statistics_and_idempotence(spark):
    chain, grammar = [(k, "n", k + 1) for k in range(12)], Grammar.of("P ::= n", "P ::= P n")
    seen = []
    out = closure(graph(spark, chain), grammar, rewrite=False, on_pass=lambda *x: seen.append(x))
    assert out.count == out.edges.count() == 12 + 78 and len(seen) == len(out.passes) and out.statistics().count() == len(out.passes)
    assert len(closure(graph(spark, chain), grammar).passes) < len(out.passes)
    assert closure(LabeledGraph.from_dataframe(out.edges), grammar).count == out.count
    with pytest.raises(RuntimeError):
        closure(graph(spark, chain), grammar, rewrite=False, max_passes=2)
    with pytest.raises(RuntimeError):
        closure(graph(spark, chain), grammar, max_edges=20)


@pytest.mark.parametrize("rules", [("P ::= n", "P ::= P n"), ("P ::= n", "P ::= n P"), ("P ::=", "P ::= P n"), ("P ::=", "P ::= n P"), ("P ::= n", "P ::= P n", "Q ::= P", "Q ::= Q P", "R ::= Q m")])
def test_chains_by_powers(spark, rules):
    """Cycles, branches and edges that have the head's label already."""
    edges = [(k, "n", k + 1) for k in range(9)] + [(9, "n", 4), (2, "n", 20), (20, "n", 21), (30, "P", 0), (21, "P", 31), (5, "m", 6), (0, "n", 1)]
    grammar = Grammar.of(*rules)
    assert result(spark, edges, grammar, 40) == closed(edges, as_tuples(grammar), range(40))


def test_long_chain_takes_no_more_than_its_pairs(spark):
    """Two thousand edges in a row: log n passes, and only candidates that are new."""
    n = 2000
    df = spark.range(n).selectExpr("id as src", "'n' as label", "id + 1 as dst")
    out = closure(LabeledGraph.from_dataframe(df), Grammar.of("P ::= n", "P ::= P n"))
    assert out.count == out.edges.count() == n + n * (n + 1) // 2 and len(out.passes) <= 15


def test_no_known_edge_is_shuffled_to_be_left_out(spark):
    known = module._Known(spark)
    edges = graph(spark, [(k, "n", k + 1) for k in range(20)]).edges
    known.add(edges.repartition(known.buckets, "src", "label", "dst"))
    plan = module.new_edges(edges, known.all())._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("LeftAnti") :]
    assert side.count("Exchange") <= 2 and "Bucketed: true" in side
    known.forget()


def sample():
    """A grammar file and a graph file that may lie beside the repository, told apart by their first numbers."""
    found = {}
    for f in glob.glob(os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "reference", "**", "*.txt"), recursive=True):
        with open(f) as lines:
            first = next((x.split() for x in lines if x.strip() and not x.startswith("#")), [])
        if all(x.isdigit() for x in first):
            found[len(first)] = f
    return found.get(1), found.get(2)


@pytest.mark.skipif(None in sample(), reason="no sample")
@pytest.mark.parametrize(("inverses", "total", "counts"), [
    ([], 3246, {"AM": 61, "AMs": 591, "MAM": 530, "MAs": 530, "Mq": 530, "V": 591, "a": 61, "d": 352}),
    (["a", "d"], 5099, {"-a": 61, "-d": 352, "AM": 62, "AMs": 592, "DV": 464, "M": 440, "MA": 62, "MAM": 685, "MAs": 592, "Mq": 618, "V": 758, "a": 61, "d": 352}),
])
def test_sample(spark, inverses, total, counts):
    """The closure of the sample program graph under the points-to rules, by label."""
    rules, edges = sample()
    found = read_graph(spark, f"file://{edges}")
    assert set(read_grammar(spark, f"file://{rules}").rules) == set(POINTS_TO.rules)
    out = closure(found.with_inverses(inverses) if inverses else found, POINTS_TO)
    assert out.count == total
    assert {r["label"]: r["count"] for r in out.edges.groupBy("label").count().collect()} == counts


@pytest.mark.parametrize("rewrite", [True, False])
def test_random_graphs(spark, rewrite):
    """Sixty graphs with rules of their own, closed at once: labels and vertices are kept apart."""
    draw, labels = random.Random(rewrite), "abcd"
    edges, rules, want = [], [], set()
    for g in range(60):
        name = lambda x, g=g: f"{g}{x}"
        own = {(10 * g + draw.randrange(6), name(draw.choice(labels)), 10 * g + draw.randrange(6)) for _ in range(draw.randrange(15))}
        some = [(name(draw.choice(labels)), *(name(x) for x in draw.choices(labels, k=draw.randrange(3)))) for _ in range(draw.randrange(1, 7))]
        if g % 3 == 0:  # a chain, over a label that other rules may derive
            some += [(name("p"), name("a")), (name("p"), *draw.sample([name("p"), name("a")], 2))]
        some = [(*r, None, None)[:3] for r in some]
        want |= closed(own, some, range(10 * g, 10 * g + 6))
        edges += own
        rules += some
    vertices = spark.createDataFrame([(10 * g + k,) for g in range(60) for k in range(6)], "id long")
    found = closure(LabeledGraph.from_dataframe(spark.createDataFrame(edges, SCHEMA), vertices), Grammar(Rule(*r) for r in rules), rewrite=rewrite)
    # rules without a right side also hold at the other graphs' vertices
    assert {tuple(r) for r in found.edges.collect() if r["label"].rstrip("abcdp") == str(r["src"] // 10)} == want


def test_points_to_takes_few_passes(spark):
    """Lines and parts are told apart, so no rule waits for memory aliases; every label has the worklist's edges."""
    edges = [(2 * k, "a", 2 * k + 2) for k in range(40) if k % 8 != 7] + [(2 * k, "d", 2 * (k * 5 % 13) + 1) for k in range(40)]
    edges += [(d, "-" + label, s) for s, label, d in edges]
    ids = {v for s, _, d in edges for v in (s, d)}
    out = closure(graph(spark, edges), POINTS_TO)
    want = closed(edges, as_tuples(POINTS_TO), ids)
    assert {tuple(r) for r in out.edges.collect()} == want and out.count == out.edges.count() == len(want)
    aliases = closure(graph(spark, edges), POINTS_TO, wanted=["M"])
    assert len(aliases.passes) < 14 and {tuple(r) for r in aliases.edges.where("label = 'M'").collect()} == {e for e in want if e[1] == "M"}


@pytest.mark.parametrize("seed", range(8))
def test_random_graphs_by_strata(spark, seed):
    """Five graphs at once, of few labels each; vertices without edges, and edges that have a head's label."""
    draw = random.Random(seed)
    edges, rules = set(), []
    for g in range(5):
        name = lambda x, g=g: f"{g}{x}"
        for _ in range(draw.randrange(14)):
            label = draw.randrange(5)
            # sources and targets of the first labels are apart, so that there are several sorts
            at = lambda apart, end, g=g: 20 * g + (6 * end if apart else 0) + draw.randrange(6)
            edges.add((at(label < 3, label % 2), name("abcde"[label]), at(label < 3, 1)))
        rules += [(name(draw.choice("abcde")), *(name(x) for x in draw.choices("abcde", k=draw.choice([0, 1, 2, 2])))) for _ in range(draw.randrange(1, 7))]
    rules = [(*r, None, None)[:3] for r in rules]
    want = closed(edges, rules, range(100))
    vertices = spark.range(100)
    found = closure(LabeledGraph.from_dataframe(spark.createDataFrame(sorted(edges), SCHEMA), vertices), Grammar(Rule(*r) for r in rules))
    rows = [tuple(r) for r in found.edges.collect()]
    assert set(rows) == want and len(rows) == len(want) == found.count


def test_counts_of_points_to_labels_take_few_passes(spark):
    """All labels, wanted or not, are closed without passes over each other."""
    edges = [(2 * k, "a", 2 * k + 2) for k in range(30) if k % 6 != 5] + [(2 * k, "d", 2 * (k * 5 % 7) + 1) for k in range(30)]
    edges += [(d, "-" + label, s) for s, label, d in edges]
    out = closure(graph(spark, edges), POINTS_TO)
    want = closed(edges, as_tuples(POINTS_TO), {v for s, _, d in edges for v in (s, d)})
    found = {r["label"]: r["count"] for r in out.edges.groupBy("label").count().collect()}
    assert found == {label: sum(e[1] == label for e in want) for label in {e[1] for e in want}}
    # one for the graph and one for each label of two sorts
    assert len(out.passes) <= 18 and out.passes[-1][2] == len(want)
