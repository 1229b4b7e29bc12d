"""One application of each kind of rule, and the set operations between passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grammar import Rule
from ..sources.tables import local_table
from .graph import EDGE


def _table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules, as many as a grammar has: a table of fixed size that is broadcast."""
    return F.broadcast(local_table(spark, [(r.lhs, r.rhs1, r.rhs2) for r in rules], "lhs string, rhs1 string, rhs2 string"))


def epsilon_edges(vertices: DataFrame, rules: list[Rule]) -> DataFrame:
    """A ::= : an edge (v, A, v) for every vertex."""
    heads = F.array(*(F.lit(h) for h in dict.fromkeys(r.lhs for r in rules))) if rules else F.array().cast("array<string>")
    return vertices.select(F.col("id").alias("src"), F.explode(heads).alias("label"), F.col("id").alias("dst"))


def apply_unit(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """A ::= B: an edge (x, A, y) for every (x, B, y)."""
    if not rules:
        return edges.limit(0)
    some = edges.where(F.col("label").isin([r.rhs1 for r in rules]))
    return some.join(_table(edges.sparkSession, rules), F.col("label") == F.col("rhs1")).select("src", F.col("lhs").alias("label"), "dst")


def apply_binary(left: DataFrame, right: DataFrame, rules: list[Rule]) -> DataFrame:
    """A ::= B C: an edge (x, A, z) for every (x, B, y) of left and (y, C, z) of right.

    Only the labels that rules have on that side are read. The join is left to the planner: it broadcasts a side that is
    small, and splits vertices that have very many edges.
    """
    if not rules:
        return left.limit(0)
    heads = left.where(F.col("label").isin([r.rhs1 for r in rules])).join(_table(left.sparkSession, rules), F.col("label") == F.col("rhs1"))
    heads = heads.select(F.col("src").alias("x"), "lhs", "rhs2", F.col("dst").alias("y"))
    tails = right.where(F.col("label").isin([r.rhs2 for r in rules])).select(F.col("src").alias("y"), F.col("label").alias("rhs2"), F.col("dst").alias("z"))
    return heads.join(tails, ["y", "rhs2"]).select(F.col("x").alias("src"), F.col("lhs").alias("label"), F.col("z").alias("dst"))


def merge_edges(*sets: DataFrame) -> DataFrame:
    """Union as a set."""
    return reduce(DataFrame.union, (s.select(*EDGE) for s in sets)).distinct()


def new_edges(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """The different candidates that are not known."""
    return candidates.select(*EDGE).distinct().join(known.select(*EDGE), list(EDGE), "left_anti")
