"""Counts of labels, degrees and bit-vector elements, and plans of vertex intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import base_of
from ..sources.tables import written


def label_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count("*").alias("n_edges"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"))


def degrees(edges: DataFrame, region: str | None = None) -> DataFrame:
    """Edges and elements by source; an element holds the targets of one label in one stretch of vertex ids."""
    kept = [region] if region else []
    parts = edges.groupBy("src", *kept, "label", base_of("dst").alias("base")).agg(F.count("*").alias("n"))
    return parts.groupBy("src", *kept).agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_elements"))


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows up to this one by `order`, without sorting all rows in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(max(1, parts), order).withColumn("__part", F.spark_partition_id()), "ranged")
    # a row for each range
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("__sum", F.sum(value).over(within)).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__sum") + F.col("__before")).drop("__part", "__sum", "__before")


def vertex_intervals(edges: DataFrame, vertices: DataFrame, budget: int) -> DataFrame:
    """(id, n_elements, pid): consecutive vertices share a pid as long as the elements before them are in one budget's worth."""
    counted = vertices.join(degrees(edges).select(F.col("src").alias("id"), "n_elements"), "id", "left").select("id", F.coalesce("n_elements", F.lit(0)).alias("n_elements"))
    return running_sum(counted, "id", "n_elements", "__upto").select("id", "n_elements", F.floor((F.col("__upto") - F.col("n_elements")) / budget).cast("long").alias("pid"))


def interval_plan(intervals: DataFrame) -> DataFrame:
    """A row for each interval of vertex_intervals()."""
    return intervals.groupBy("pid").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("n_elements").alias("n_elements"))


def pair_weights(edges: DataFrame, intervals: DataFrame) -> DataFrame:
    """For intervals p, q with edges from p into q, p <> q: the sum over those edges of the target's out-degree."""
    degree = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("degree"))
    ends = lambda end, name: intervals.select(F.col("id").alias(end), F.col("pid").alias(name))
    crossing = edges.join(ends("src", "p"), "src").join(ends("dst", "q"), "dst").where("p <> q")
    return crossing.join(degree, "dst", "left").groupBy("p", "q").agg(F.sum(F.coalesce("degree", F.lit(0))).cast("long").alias("weight"))


def next_pair(weights: DataFrame) -> DataFrame:
    """The pair p < q of the largest weight both ways; among equals the first."""
    both = weights.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.sum("weight").alias("weight"))
    return both.orderBy(F.desc("weight"), "p", "q").limit(1)
