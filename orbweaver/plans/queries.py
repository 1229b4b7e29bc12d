"""Named queries over the test tables, each with its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import base_of, bit_of, unit_of, vertex_of
from ..operators.closure import closure
from ..operators.graph import LabeledGraph
from ..operators.rules import apply_binary, apply_unit, epsilon_edges, merge_edges, new_edges
from ..operators.statistics import degrees, edge_count, interval_plan, label_counts, next_pair, pair_weights, vertex_intervals
from ..sources.files import adjacency, edges_of, read_edges, read_grammar, read_graph, within, write_edges, write_grammar, write_graph
from ..sources.tables import local_table, new_path
from .grammar import Grammar, Rule

#: The usual points-to grammar, memory aliases (M) and value aliases (V) over dereferences (d) and assignments (a).
POINTS_TO = Grammar.of(
    "M ::= DV d", "DV ::= -d V", "V ::= MAM AMs", "MAM ::= MAs Mq", "Mq ::=", "Mq ::= M",
    "MAs ::=", "MAs ::= MAs MA", "MA ::= Mq -a", "AMs ::=", "AMs ::= AMs AM", "AM ::= a Mq",
)
REACH = Grammar.of("P ::= n", "P ::= P n")
BALANCED = Grammar.of("S ::=", "S ::= S S", "OS ::= o S", "S ::= OS c")
SAME_GENERATION = Grammar.of("SG ::=", "US ::= u SG", "SG ::= US -u")
FLOW = Grammar.of("N ::= N e")

#: Elements that an interval of the interval plan is meant to have.
BUDGET = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(df: DataFrame, vertex, key: list[str], order: list[str], label) -> DataFrame:
    """An edge from each row's vertex to that of the next row with the same key."""
    then = F.lead(vertex).over(Window.partitionBy(*key).orderBy(*order))
    return df.select(vertex.cast("long").alias("src"), label.alias("label"), then.cast("long").alias("dst")).where("dst is not null")


def conversation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return _steps(turns, F.col("conv_id") * 1000 + F.col("turn"), ["conv_id"], ["turn"], F.lit("n"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return _steps(orders, F.col("o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.lit("n"))


def event_edges(spark: SparkSession, sf_dir: str, label) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return _steps(events, F.col("event_id"), ["user_id"], ["ts", "event_id"], label)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window]:
    """The lines of orders, each with a vertex of its own, and their order."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lines.withColumn("line", (F.col("l_orderkey") * 100 + F.row_number().over(along)).cast("long")), along


def line_edges(spark: SparkSession, sf_dir: str, label: str = "n", scale: int = 1) -> DataFrame:
    """An edge from each line to the next of the same order."""
    lines, along = _lines(spark, sf_dir)
    steps = lines.select((F.col("line") * scale).alias("src"), F.lit(label).alias("label"), (F.lead("line").over(along) * scale).alias("dst"))
    return steps.where("dst is not null")


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -u-> nation -u-> region, with vertices of their own for each table."""
    supplier, nation = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    up = supplier.select((F.col("s_suppkey").cast("long") * 10).alias("src"), F.lit("u").alias("label"), (F.col("s_nationkey").cast("long") * 10 + 1).alias("dst"))
    return up.union(nation.select((F.col("n_nationkey").cast("long") * 10 + 1), F.lit("u"), (F.col("n_regionkey").cast("long") * 10 + 2)))


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a: a line is assigned to the next of its order; d: a line refers to its part. Lines are even, parts odd."""
    lines, along = _lines(spark, sf_dir)
    edge = lambda label, dst: F.struct((F.col("line") * 2).alias("src"), F.lit(label).alias("label"), dst.cast("long").alias("dst"))
    both = F.array(edge("a", F.col("then") * 2), edge("d", F.col("l_partkey") * 2 + 1))
    edges = lines.withColumn("then", F.lead("line").over(along)).select(F.explode(both).alias("e")).select("e.*")
    return edges.where("label = 'd' or dst is not null")


def _closed(edges: DataFrame, grammar: Grammar, label: str, mode: str = "full", inverses: list[str] | None = None) -> DataFrame:
    graph = LabeledGraph.from_dataframe(edges)
    if inverses:
        graph = graph.with_inverses(inverses)
    return closure(graph, grammar, mode, wanted=[label]).edges.where(F.col("label") == label)


def conv_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later turn that a turn leads to."""
    return _closed(conversation_edges(spark, sf_dir), REACH, "P")


def order_chain_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later order of the same customer."""
    return _closed(order_edges(spark, sf_dir), REACH, "P")


def dyck_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events in which views and purchases balance like brackets."""
    kind = F.when(F.col("event_type") == "view", "o").when(F.col("event_type") == "purchase", "c").otherwise("x")
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    graph = LabeledGraph.from_dataframe(event_edges(spark, sf_dir, kind), events)
    return closure(graph, BALANCED).edges.where("label = 'S'")


def same_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers, nations or regions at the same height below a common place."""
    return _closed(place_edges(spark, sf_dir), SAME_GENERATION, "SG", inverses=["u"])


def alias_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory aliases under the points-to grammar: parts that lines of one order refer to."""
    return _closed(alias_edges(spark, sf_dir), POINTS_TO, "M", inverses=["a", "d"])


def line_flow_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later line of the same order."""
    return _closed(line_edges(spark, sf_dir), REACH, "P")


def dataflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a signup flows to without passing an error, in dataflow mode."""
    seeds = event_edges(spark, sf_dir, F.col("event_type")).where("label = 'signup'").withColumn("label", F.lit("N"))
    steps = event_edges(spark, sf_dir, F.col("event_type")).where("label <> 'error'").withColumn("label", F.lit("e"))
    return _closed(seeds.union(steps), FLOW, "N", mode="dataflow")


def points_to_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each label in the whole closure under the points-to grammar."""
    return label_counts(closure(LabeledGraph.from_dataframe(alias_edges(spark, sf_dir)).with_inverses(["a", "d"]), POINTS_TO).edges)


def eps_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_edges(LabeledGraph.from_dataframe(place_edges(spark, sf_dir)).vertices, [Rule("A")])


def unit_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_unit(order_edges(spark, sf_dir), [Rule("A", "n")])


def compose_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = place_edges(spark, sf_dir)
    return apply_binary(edges, edges, [Rule("A", "u", "u")]).distinct()


def delta_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a line and one of the next two of its order that are no pairs of neighbours."""
    lines = line_edges(spark, sf_dir)
    return new_edges(apply_binary(lines, lines, [Rule("n", "n", "n")]).union(lines), lines)


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_edges(order_edges(spark, sf_dir), line_edges(spark, sf_dir), order_edges(spark, sf_dir))


def degree_by_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(alias_edges(spark, sf_dir)).select("src", "n_edges")


def elements_by_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(alias_edges(spark, sf_dir)).select("src", "n_elements")


def label_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_counts(closure(LabeledGraph.from_dataframe(conversation_edges(spark, sf_dir)), REACH).edges)


def final_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_count(closure(LabeledGraph.from_dataframe(line_edges(spark, sf_dir)), REACH).edges)


def adjacency_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency(alias_edges(spark, sf_dir)).select("src", "label", "base", F.array_join("targets", ",").alias("targets"))


def adjacency_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(adjacency(alias_edges(spark, sf_dir)))


def bit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each target stands in the bit vectors, and the target that this place gives."""
    places = alias_edges(spark, sf_dir).select("dst", base_of("dst").alias("base"), unit_of("dst").alias("unit"), bit_of("dst").alias("bit")).distinct()
    return places.withColumn("vertex", vertex_of("base", "unit", "bit"))


def interval_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the sources of one interval."""
    return within(alias_edges(spark, sf_dir), 10_000, 200_000)


def distinct_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_edges(spark, sf_dir).agg(F.count_distinct("label").alias("n_labels"))


def degree_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and elements of each source among known edges (old) and among those that one more step adds (delta)."""
    old = place_edges(spark, sf_dir)
    delta = new_edges(apply_binary(old, old, [Rule("u", "u", "u")]), old)
    return degrees(old.withColumn("region", F.lit("old")).union(delta.withColumn("region", F.lit("delta"))), "region")


def grammar_file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a grammar file that is written and read back."""
    path = new_path(spark, "grammar")
    write_grammar(spark, POINTS_TO, path)
    rules = [(n, r.lhs, r.rhs1, r.rhs2) for n, r in enumerate(read_grammar(spark, path).rules)]
    return local_table(spark, rules, "rule int, lhs string, rhs1 string, rhs2 string")


def rule_label_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels the rules of a grammar name."""
    names = grammar_file_rules(spark, sf_dir).select(F.explode(F.array("lhs", "rhs1", "rhs2")).alias("label")).where("label is not null")
    return names.agg(F.count_distinct("label").alias("n_labels"))


def graph_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a graph file, written by ascending source and read back."""
    path = new_path(spark, "graph")
    write_graph(LabeledGraph.from_dataframe(alias_edges(spark, sf_dir)), path)
    return read_graph(spark, path).edges


def graph_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of edges and vertices that a graph file says in its first line."""
    path = new_path(spark, "graph")
    edges = LabeledGraph.from_dataframe(place_edges(spark, sf_dir))
    write_graph(edges, path)
    found = read_graph(spark, path)
    return found.edges.agg(F.count("*").alias("n_edges")).withColumn("n_vertices", found.vertices.agg(F.count("*")).scalar())


def edge_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by label in folders: those of one label and an interval of sources, read back."""
    path = new_path(spark, "folders")
    write_edges(alias_edges(spark, sf_dir), path)
    return read_edges(spark, path, ["d"], (10_000, 200_000))


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = alias_edges(spark, sf_dir)
    return edges, vertex_intervals(edges, LabeledGraph.from_dataframe(edges).vertices, BUDGET)


def interval_plan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_plan(_intervals(spark, sf_dir)[1])


def pair_weights_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_weights(*_intervals(spark, sf_dir))


def next_pair_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_pair(pair_weights(*_intervals(spark, sf_dir)))


def inverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LabeledGraph.from_dataframe(place_edges(spark, sf_dir)).with_inverses(["u"]).edges


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_q"): f
    for f in (
        conv_reach, order_chain_reach, dyck_events, same_generation, alias_points_to, line_flow_reach, dataflow_events, points_to_labels,
        eps_only, unit_rename, compose_once, delta_except, union_dedup, degree_by_src, elements_by_src, label_counts_q, final_edge_count,
        adjacency_export, adjacency_decode, bit_positions, interval_scan, distinct_label_count, degree_by_region, interval_plan_q, pair_weights_q, next_pair_q, inverse_edges,
        grammar_file_rules, rule_label_count, graph_file_edges, graph_file_sizes, edge_folder_scan,
    )
}

# The same edges in SQL, as common table expressions e(s, l, d)
_CONV = "c AS (SELECT conv_id * 1000 + turn AS s, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations), e AS (SELECT DISTINCT s::BIGINT AS s, 'n' AS l, d::BIGINT AS d FROM c WHERE d IS NOT NULL)"
_ORDERS = "c AS (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders), e AS (SELECT s::BIGINT AS s, 'n' AS l, d::BIGINT AS d FROM c WHERE d IS NOT NULL)"
_LINES = "lc AS (SELECT l_partkey, l_orderkey * 100 + row_number() OVER w AS line, l_orderkey * 100 + row_number() OVER w + 1 AS follower, lead(1) OVER w AS more FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), le AS (SELECT line::BIGINT AS s, 'n' AS l, follower::BIGINT AS d FROM lc WHERE more IS NOT NULL)"
_EVENTS = "c AS (SELECT event_id AS s, event_type AS t, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)"
_PLACES = "e AS (SELECT s_suppkey::BIGINT * 10 AS s, 'u' AS l, s_nationkey::BIGINT * 10 + 1 AS d FROM supplier UNION SELECT n_nationkey::BIGINT * 10 + 1, 'u', n_regionkey::BIGINT * 10 + 2 FROM nation)"
_ALIAS = _LINES + ", e AS (SELECT s * 2 AS s, 'a' AS l, d * 2 AS d FROM le UNION ALL SELECT line::BIGINT * 2, 'd', l_partkey::BIGINT * 2 + 1 FROM lc)"
_INVERSE = "i AS (SELECT s, l, d FROM e UNION SELECT d, '-' || l, s FROM e)"


def _linear(ctes: str, edges: str = "e") -> str:
    """P ::= n and P ::= P n."""
    return f"WITH RECURSIVE {ctes}, p(s, d) AS (SELECT s, d FROM {edges} UNION SELECT p.s, {edges}.d FROM p JOIN {edges} ON p.d = {edges}.s) SELECT s AS src, 'P' AS label, d AS dst FROM p"


def _full(ctes: str, edges: str, vertices: str, grammar: Grammar, out: str) -> str:
    """The closure of any grammar: each step joins what the last one added with all there is, both ways."""
    rules = ", ".join(f"('{r.lhs}', '{r.rhs1 or ''}', '{r.rhs2 or ''}')" for r in grammar.rules)
    return f"""WITH RECURSIVE {ctes}, rl(lhs, b, c) AS (VALUES {rules}), vv(v) AS ({vertices}),
z(s, l, d) USING KEY (s, l, d) AS (
  (SELECT s::BIGINT AS s, l::VARCHAR AS l, d::BIGINT AS d FROM {edges} UNION SELECT v, lhs, v FROM vv, rl WHERE b = '')
  UNION (
    SELECT z.s, r.lhs, z.d FROM z JOIN rl r ON r.b = z.l AND r.c = '' AND r.b <> ''
    UNION SELECT x.s, r.lhs, y.d FROM z x JOIN rl r ON r.b = x.l JOIN recurring.z y ON y.l = r.c AND y.s = x.d
    UNION SELECT x.s, r.lhs, y.d FROM recurring.z x JOIN rl r ON r.b = x.l JOIN z y ON y.l = r.c AND y.s = x.d))
{out}"""


def _of(label: str) -> str:
    return f"SELECT s AS src, l AS label, d AS dst FROM z WHERE l = '{label}'"


_ENDS = "SELECT s FROM {0} UNION SELECT d FROM {0}"
_ELEMENTS = "n AS (SELECT s, count(DISTINCT (d // 192, l)) AS n FROM e GROUP BY s), v AS (SELECT s AS id FROM e UNION SELECT d FROM e), k AS (SELECT id, coalesce(n.n, 0) AS n FROM v LEFT JOIN n ON n.s = v.id)"
_PID = f"{_ELEMENTS}, pids AS (SELECT id, n, ((sum(n) OVER (ORDER BY id) - n) // {BUDGET})::BIGINT AS pid FROM k)"
_WEIGHTS = f"{_PID}, deg AS (SELECT s, count(*) AS n FROM e GROUP BY s), w AS (SELECT a.pid AS p, b.pid AS q, sum(coalesce(deg.n, 0))::BIGINT AS weight FROM e JOIN pids a ON a.id = e.s JOIN pids b ON b.id = e.d LEFT JOIN deg ON deg.s = e.d WHERE a.pid <> b.pid GROUP BY ALL)"

_quoted = lambda x: "NULL" if x is None else f"'{x}'"
_RULES = ", ".join(f"({n}, {_quoted(r.lhs)}, {_quoted(r.rhs1)}, {_quoted(r.rhs2)})" for n, r in enumerate(POINTS_TO.rules))

ORACLES: dict[str, str] = {
    "conv_reach": _linear(_CONV),
    "order_chain_reach": _linear(_ORDERS),
    "line_flow_reach": _linear(_LINES, "le"),
    "dyck_events": _full(_EVENTS + ", e AS (SELECT s, CASE t WHEN 'view' THEN 'o' WHEN 'purchase' THEN 'c' ELSE 'x' END AS l, d FROM c WHERE d IS NOT NULL)", "e", "SELECT event_id FROM events", BALANCED, _of("S")),
    "same_generation": _full(f"{_PLACES}, {_INVERSE}", "i", _ENDS.format("i"), SAME_GENERATION, _of("SG")),
    "alias_points_to": _full(f"{_ALIAS}, {_INVERSE}", "i", _ENDS.format("i"), POINTS_TO, _of("M")),
    "points_to_labels": _full(f"{_ALIAS}, {_INVERSE}", "i", _ENDS.format("i"), POINTS_TO, "SELECT l AS label, count(*) AS n_edges FROM z GROUP BY l"),
    "dataflow_events": f"WITH RECURSIVE {_EVENTS}, e AS (SELECT s::BIGINT AS s, d::BIGINT AS d, t FROM c WHERE d IS NOT NULL), p(s, d) AS (SELECT s, d FROM e WHERE t = 'signup' UNION SELECT p.s, e.d FROM p JOIN e ON p.d = e.s WHERE e.t <> 'error') SELECT s AS src, 'N' AS label, d AS dst FROM p",
    "eps_only": f"WITH {_PLACES} SELECT v AS src, 'A' AS label, v AS dst FROM (SELECT s AS v FROM e UNION SELECT d FROM e)",
    "unit_rename": f"WITH {_ORDERS} SELECT s AS src, 'A' AS label, d AS dst FROM e",
    "compose_once": f"WITH {_PLACES} SELECT DISTINCT x.s AS src, 'A' AS label, y.d AS dst FROM e x JOIN e y ON x.d = y.s",
    "delta_except": f"WITH {_LINES} SELECT x.s AS src, 'n' AS label, y.d AS dst FROM le x JOIN le y ON x.d = y.s EXCEPT SELECT s, l, d FROM le",
    "union_dedup": f"WITH {_ORDERS}, {_LINES} SELECT s AS src, l AS label, d AS dst FROM e UNION SELECT s, l, d FROM le",
    "degree_by_src": f"WITH {_ALIAS} SELECT s AS src, count(*) AS n_edges FROM e GROUP BY s",
    "elements_by_src": f"WITH {_ALIAS} SELECT s AS src, count(DISTINCT (d // 192, l)) AS n_elements FROM e GROUP BY s",
    "label_counts": f"WITH RECURSIVE {_CONV}, p(s, d) AS (SELECT s, d FROM e UNION SELECT p.s, e.d FROM p JOIN e ON p.d = e.s) SELECT 'n' AS label, count(*) AS n_edges FROM e HAVING count(*) > 0 UNION ALL SELECT 'P', count(*) FROM p HAVING count(*) > 0",
    "final_edge_count": f"WITH RECURSIVE {_LINES}, p(s, d) AS (SELECT s, d FROM le UNION SELECT p.s, le.d FROM p JOIN le ON p.d = le.s) SELECT (SELECT count(*) FROM le) + (SELECT count(*) FROM p) AS n_edges",
    "adjacency_export": f"WITH {_ALIAS} SELECT s AS src, l AS label, d // 192 AS base, string_agg(d::VARCHAR, ',' ORDER BY d) AS targets FROM e GROUP BY s, l, d // 192",
    "adjacency_decode": f"WITH {_ALIAS} SELECT s AS src, l AS label, d AS dst FROM e",
    "bit_positions": f"WITH {_ALIAS} SELECT DISTINCT d AS dst, d // 192 AS base, (d % 192 // 32)::INTEGER AS unit, (d % 32)::INTEGER AS bit, d AS vertex FROM e",
    "interval_scan": f"WITH {_ALIAS} SELECT s AS src, l AS label, d AS dst FROM e WHERE s BETWEEN 10000 AND 200000",
    "distinct_label_count": f"WITH {_ALIAS} SELECT count(DISTINCT l) AS n_labels FROM e",
    "degree_by_region": f"WITH {_PLACES}, t AS (SELECT DISTINCT x.s, x.l, y.d FROM e x JOIN e y ON x.d = y.s), a AS (SELECT *, 'old' AS region FROM e UNION ALL (SELECT *, 'delta' FROM (SELECT s, l, d FROM t EXCEPT SELECT s, l, d FROM e))) SELECT s AS src, region, count(*) AS n_edges, count(DISTINCT (d // 192, l)) AS n_elements FROM a GROUP BY s, region",
    "interval_plan": f"WITH {_ALIAS}, {_PID} SELECT pid, min(id) AS first_id, max(id) AS last_id, sum(n)::BIGINT AS n_elements FROM pids GROUP BY pid",
    "pair_weights": f"WITH {_ALIAS}, {_WEIGHTS} SELECT p, q, weight FROM w",
    "next_pair": f"WITH {_ALIAS}, {_WEIGHTS} SELECT least(p, q) AS p, greatest(p, q) AS q, sum(weight)::BIGINT AS weight FROM w GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT 1",
    "grammar_file_rules": f"SELECT * FROM (VALUES {_RULES}) t(rule, lhs, rhs1, rhs2)",
    "rule_label_count": f"WITH r(rule, lhs, rhs1, rhs2) AS (VALUES {_RULES}) SELECT count(DISTINCT x) AS n_labels FROM (SELECT lhs AS x FROM r UNION ALL SELECT rhs1 FROM r UNION ALL SELECT rhs2 FROM r)",
    "graph_file_edges": f"WITH {_ALIAS} SELECT DISTINCT s AS src, l AS label, d AS dst FROM e",
    "graph_file_sizes": f"WITH {_PLACES} SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT max(greatest(s, d)) + 1 FROM e) AS n_vertices",
    "edge_folder_scan": f"WITH {_ALIAS} SELECT s AS src, l AS label, d AS dst FROM e WHERE l = 'd' AND s BETWEEN 10000 AND 200000",
    "inverse_edges": f"WITH {_PLACES}, {_INVERSE} SELECT s AS src, l AS label, d AS dst FROM i",
}
