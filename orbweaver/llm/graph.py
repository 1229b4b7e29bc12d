"""Connected components of links, in Spark and, for the links of one block, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_written, written


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b (and those already in parent) join it to."""
    parent = np.arange(n) if parent is None else parent
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable. links: a long, b long.

    Rounds of small-star and large-star steps turn the links into stars whose centres are the smallest nodes; the number
    of rounds grows with the logarithm of the longest path. Each step joins the links with one row per node, both read
    from written tables, so that Spark may split a node with very many links over tasks; nothing is gathered on the driver
    but three counts.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        least = written(edges.groupBy("hi").agg(F.min("lo").alias("least")), "least")
        below = edges.join(least.withColumnRenamed("hi", "lo").withColumnRenamed("least", "below"), "lo", "left_semi").limit(1).count()
        if not below and edges.count() == least.count():
            drop_written(least)
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        moved = edges.join(least, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = written(moved.union(least.select("hi", F.col("least").alias("lo"))).distinct(), "small-star")
        drop_written(edges)
        drop_written(least)
        # large star: the larger neighbours of a node go to its least neighbour
        up = written(small.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least")), "up")
        edges = written(small.join(up, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct(), "large-star")
        drop_written(small)
        drop_written(up)
