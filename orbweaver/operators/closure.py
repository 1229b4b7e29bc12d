"""The least set of edges that holds a graph's edges and all that its rules imply."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.grammar import Grammar, Rule
from ..sources.tables import drop_written, local_table, new_path, written
from . import strata
from .graph import EDGE, LabeledGraph
from .rules import apply_binary, apply_unit, epsilon_edges, merge_edges, new_edges

SCHEMA = "src long, label string, dst long"


class _Known:
    """The edges known so far: a table in the shared folder, bucketed by the whole edge, with a folder for each pass.

    A pass appends its new edges and rewrites none. What a pass finds is dealt by the whole edge to be made distinct, so
    it meets the known edges bucket by bucket: they are not shuffled to be left out, and no vertex makes a bucket large.
    Within files edges stand by label and source, so that reads of some labels skip pages of others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_path(spark, "edges")
        self.name = "edges_" + self.path.rpartition("-")[2]
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.last = -1

    def add(self, df: DataFrame) -> int:
        """Append a pass's edges, all different and new; gives their number."""
        self.last += 1
        seen = Observation()
        rows = df.select(*EDGE).observe(seen, F.count(F.lit(1)).alias("n")).withColumn("pass", F.lit(self.last))
        rows.write.format("parquet").mode("append").option("path", self.path).partitionBy("pass").bucketBy(self.buckets, *EDGE).sortBy("label", "src").saveAsTable(self.name)
        return seen.get["n"]

    def all(self) -> DataFrame:
        return self.spark.table(self.name).select(*EDGE)

    def fresh(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("pass") == self.last).select(*EDGE)

    def before(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("pass") < self.last).select(*EDGE)

    def first(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("pass") == 0).select(*EDGE)

    def forget(self) -> None:
        """Take the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@dataclass
class ClosureResult:
    """edges: all of them, from tables in the shared folder; passes: (pass, new edges, all edges, seconds)."""

    edges: DataFrame
    passes: list[tuple[int, int, int, float]] = field(default_factory=list)

    @property
    def count(self) -> int:
        return self.passes[-1][2]

    def statistics(self) -> DataFrame:
        return local_table(self.edges.sparkSession, self.passes, "pass int, new_edges long, all_edges long, seconds double")


def closure(
    graph: LabeledGraph,
    grammar: Grammar,
    mode: str = "full",
    wanted: list[str] | None = None,
    rewrite: bool = True,
    max_passes: int | None = None,
    max_edges: int | None = None,
    on_pass: Callable[[int, int, int], None] | None = None,
) -> ClosureResult:
    """Semi-naive: each pass joins only what the last one added with what is known, in both orders.

    mode: "full", or "dataflow" for grammars without unit rules whose right operands are never derived; there the new
    edges alone are joined, with the graph's own. It raises ValueError for other grammars, as it would lose edges.
    wanted: labels of which all edges are needed; rules that cannot matter to them are left out.
    rewrite: tell rules apart by sorts of vertices and close each label when those that it needs are closed, P ::= P x by
    doubling (the same edges, fewer passes; see strata). Grammars of more than strata.LABELS labels are closed at once.
    max_passes, max_edges: RuntimeError beyond that.
    """
    if mode not in ("full", "dataflow"):
        raise ValueError(f"mode is full or dataflow, not {mode!r}")
    if wanted is not None:
        grammar = grammar.sliced(wanted)
    if mode == "dataflow" and (faults := grammar.dataflow_faults()):
        raise ValueError("dataflow mode would lose edges: " + "; ".join(faults))
    spark = graph.edges.sparkSession
    passes, total = [], 0

    def counted(new: int, began: float) -> None:
        nonlocal total
        total += new
        passes.append((len(passes), new, total, time.perf_counter() - began))
        if on_pass:
            on_pass(*passes[-1][:3])
        if max_edges is not None and total > max_edges:
            raise RuntimeError(f"{total} edges, more than max_edges")
        if new and max_passes is not None and len(passes) > max_passes:
            raise RuntimeError(f"not closed after {max_passes} passes")

    if mode == "full" and rewrite and len(grammar.labels) <= strata.LABELS:
        return ClosureResult(strata.closed(graph, grammar, wanted, counted, lambda *of: _together(spark, *of, counted)), passes)
    known = _Known(spark)
    try:
        began = time.perf_counter()
        start = merge_edges(graph.edges, epsilon_edges(graph.vertices, grammar.epsilon)) if grammar.epsilon else graph.edges.select(*EDGE).distinct()
        counted(known.add(start.repartition(known.buckets, *EDGE)), began)
        if mode == "full" and rewrite:
            while (chain := grammar.chain()) is not None:
                _powers(known, chain, counted)
                grammar = grammar.without(chain[0])
        _closed(known, grammar, mode, counted)
    finally:
        known.forget()
    return ClosureResult(spark.read.schema(SCHEMA + ", pass int").parquet(known.path).select(*EDGE), passes)


def _together(spark: SparkSession, begin: dict, rules: dict, given: int, began: float, counted: Callable[[int, float], None]) -> dict:
    """The edges of symbols that need each other, by passes; given: those of them that the graph had."""
    name = {x: str(n) for n, x in enumerate(dict.fromkeys([*begin, *rules, *(x for own in rules.values() for body in own for x in body)]))}
    grammar = Grammar(Rule(name[h], *(name[x] for x in body)) for h, own in rules.items() for body in own)
    known = _Known(spark)
    try:
        start = [df.select("src", F.lit(name[x]).alias("label"), "dst") for x, df in begin.items()]
        start = reduce(DataFrame.union, start) if start else spark.createDataFrame([], SCHEMA)
        known.add(start.repartition(known.buckets, *EDGE))
        counted(known.first().where(F.col("label").isin([name[h] for h in rules])).count() - given, began)
        _closed(known, grammar, "full", counted)
    finally:
        known.forget()
    all_ = spark.read.schema(SCHEMA + ", pass int").parquet(known.path)
    return {h: all_.where(F.col("label") == name[h]).select("src", "dst") for h in rules}


def _closed(known: _Known, grammar: Grammar, mode: str, counted: Callable[[int, float], None]) -> None:
    """Passes over all rules until one adds nothing. The first joins all that is known."""
    heads = sorted(grammar.nonterminals)
    whole = True
    while grammar.unit or grammar.binary:
        began = time.perf_counter()
        fresh = known.all() if whole else known.fresh()
        if mode == "dataflow":
            found = apply_binary(fresh, known.first(), grammar.binary)
        elif whole:
            found = apply_binary(fresh, fresh, grammar.binary)
        else:
            found = apply_binary(fresh, known.all(), grammar.binary).union(apply_binary(known.before(), fresh, grammar.binary))
        if mode != "dataflow" and grammar.unit:
            found = found.union(apply_unit(fresh, grammar.unit))
        # only derived labels can come again
        new = known.add(new_edges(found, known.all().where(F.col("label").isin(heads))))
        whole = False
        counted(new, began)
        if not new:
            return


def _powers(known: _Known, chain: tuple[str, str, bool], counted: Callable[[int, float], None]) -> None:
    """All edges of P ::= x and P ::= P x (or x P), x being closed: paths of up to 2^k steps go on by those of just 2^k.

    Every path but the first is made once from each way to it, so a chain of n edges takes n^2 / 2 candidates in log n
    passes; P ::= P P would make each path from all its middles.
    """
    head, step, onward = chain
    own = lambda: known.all().where(F.col("label") == head)
    power = written(known.all().where(F.col("label") == step).select("src", "dst"), "power")
    began = time.perf_counter()
    counted(known.add(new_edges(power.select("src", F.lit(head).alias("label"), "dst"), own())), began)
    new = 1
    while new:
        began = time.perf_counter()
        more = power.select(F.col("src").alias("y"), F.col("dst").alias("z"))
        if onward:
            found = own().join(more, F.col("dst") == F.col("y")).select("src", "label", F.col("z").alias("dst"))
        else:
            found = own().join(more, F.col("src") == F.col("z")).select(F.col("y").alias("src"), "label", "dst")
        new = known.add(new_edges(found, own()))
        counted(new, began)
        if new:
            longer = written(power.join(more, F.col("dst") == F.col("y")).select("src", F.col("z").alias("dst")).distinct(), "power")
            drop_written(power)
            power = longer
    drop_written(power)
