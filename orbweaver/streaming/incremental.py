"""Closures of graphs that grow: edges that arrive later extend a closure without computing it anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closure import SCHEMA
from ..operators.graph import EDGE
from ..operators.rules import apply_binary, apply_unit, epsilon_edges, merge_edges, new_edges
from ..plans.grammar import Grammar
from ..sources.tables import drop_written, local_table, written


def extend(closed: DataFrame, edges: DataFrame, grammar: Grammar, tables: list[DataFrame] | None = None) -> DataFrame:
    """The edges that a closed set and new edges imply and that the closed set has not, the new ones among them.

    tables: gets the tables that the result reads, which drop_written() removes when it has been saved.
    """
    tables = [] if tables is None else tables
    fresh = merge_edges(edges, epsilon_edges(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), grammar.epsilon))
    delta = written(new_edges(fresh, closed), "fresh")
    tables.append(delta)
    added = delta
    while delta.limit(1).count():
        known = closed.select(*EDGE).union(added)
        found = apply_binary(delta, known, grammar.binary).union(apply_binary(known, delta, grammar.binary))
        if grammar.unit:
            found = found.union(apply_unit(delta, grammar.unit))
        delta = written(new_edges(found, known), "fresh")
        tables.append(delta)
        added = added.union(delta)
    return added


def closure_stream(spark: SparkSession, edges: DataFrame, grammar: Grammar, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the closure of a stream of edges at `path`, a folder for each micro-batch; a batch done again overwrites its own.

    edges: a streaming DataFrame of src, label, dst. Read the closure with read_closure().
    """

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        closed, tables = read_closure(session, path, before=number), []
        edges = batch.select(F.col("src").cast("long"), F.col("label").cast("string"), F.col("dst").cast("long")).distinct()
        extend(closed, edges, grammar, tables).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for table in tables:
            drop_written(table)

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def read_closure(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The closure kept at path, of the batches before a number if one is given."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return local_table(spark, [], SCHEMA)
    found = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    return (found if before is None else found.where(F.col("batch") < before)).select(*EDGE)
