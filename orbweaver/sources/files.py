"""Grammar and graph files, Parquet tables of edges, and adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import base_of
from ..operators.graph import LabeledGraph
from ..plans.grammar import Grammar
from .tables import local_table


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither comments nor blank, without carriage returns at their ends."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r+$", "").alias("line")).where((F.trim("line") != "") & ~F.col("line").startswith("#"))


def read_grammar(spark: SparkSession, path: str) -> Grammar:
    """A grammar file; it is small, and read whole on the driver."""
    return Grammar.parse("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_grammar(spark: SparkSession, grammar: Grammar, path: str) -> None:
    """One text file in the form that read_grammar() reads."""
    local_table(spark, [(grammar.to_text().rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def read_graph(spark: SparkSession, path: str) -> LabeledGraph:
    """A graph file: a line with the numbers of edges and of vertices, then src, dst and label of an edge a line, between tabs.

    The edges may be in any order. Raises ValueError if a line is neither, if the first line's numbers are not those
    found, or if a vertex is out of range.
    """
    parts = _lines(spark, path).select(F.split("line", "\t").alias("p"))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("long")
    rows = parts.select(F.size("p").alias("n"), number(1).alias("src"), number(2).alias("dst"), F.try_element_at("p", F.lit(3)).alias("label"))
    head, edge = F.col("n") == 2, (F.col("n") == 3) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("label") != "")
    seen = rows.agg(
        F.count(F.when(head, 1)).alias("heads"),
        F.max(F.when(head, F.col("src"))).alias("edges"),
        F.max(F.when(head, F.col("dst"))).alias("vertices"),
        F.count(F.when(edge, 1)).alias("found"),
        F.count(F.when(~head & ~F.coalesce(edge, F.lit(False)), 1)).alias("bad"),
        F.min(F.when(edge, F.least("src", "dst"))).alias("low"),
        F.max(F.when(edge, F.greatest("src", "dst"))).alias("high"),
    ).first()
    if seen["heads"] != 1 or seen["vertices"] is None or seen["edges"] is None:
        raise ValueError("a graph file has one line with the numbers of edges and vertices")
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} lines are no edges")
    if seen["found"] != seen["edges"]:
        raise ValueError(f"{seen['edges']} edges announced, {seen['found']} found")
    if seen["found"] and (seen["low"] < 0 or seen["high"] >= seen["vertices"]):
        raise ValueError(f"a vertex is not one of 0 to {seen['vertices'] - 1}")
    return LabeledGraph.from_dataframe(rows.where(edge).select("src", "label", "dst"), int(seen["vertices"]))


def write_graph(graph: LabeledGraph, path: str) -> None:
    """Text in the form that read_graph() reads, in files by ascending source; the first has the numbers alone."""
    edges = graph.edges.orderBy("src", "dst", "label").select(F.concat_ws("\t", "src", "dst", "label").alias("value"))
    spark = graph.edges.sparkSession
    highest = graph.vertices.agg(F.max("id")).first()[0]
    head = local_table(spark, [(f"{graph.edges.count()}\t{0 if highest is None else highest + 1}",)], "value string")
    head.coalesce(1).write.text(path)
    edges.write.mode("append").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Parquet with a folder for each label, so that a read of some labels skips the others."""
    edges.repartition("label", F.pmod(F.xxhash64("src"), F.lit(64))).sortWithinPartitions("label", "src").write.partitionBy("label").parquet(path)


def read_edges(spark: SparkSession, path: str, labels: list[str] | None = None, sources: tuple[int, int] | None = None) -> DataFrame:
    """Edges of write_edges(): of some labels, whose folders alone are read, and of sources from one number to another."""
    found = spark.read.parquet(path).select("src", F.col("label").cast("string"), "dst")
    if labels is not None:
        found = found.where(F.col("label").isin(labels))
    return found if sources is None else within(found, *sources)


def within(edges: DataFrame, first: int, last: int) -> DataFrame:
    """The edges whose source is in an interval; Parquet skips row groups without any."""
    return edges.where(F.col("src").between(first, last))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, label, base, targets): the sorted targets of each source and label in each bit-vector element, WIDTH at most.

    So a source with very many edges has many rows, over many tasks, and none that grows with it.
    """
    return edges.groupBy("src", "label", base_of("dst").alias("base")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def edges_of(lists: DataFrame) -> DataFrame:
    """The edges of adjacency lists."""
    return lists.select("src", "label", F.explode("targets").alias("dst"))


def bitmaps(edges: DataFrame) -> DataFrame:
    """(src, label, bucket, bits): targets as bit maps of 32768 bits, several to a source where they spread."""
    return edges.groupBy("src", "label", F.bitmap_bucket_number("dst").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("dst")).alias("bits"))
