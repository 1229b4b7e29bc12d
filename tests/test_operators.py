import pytest

from orbweaver.functions import bits
from orbweaver.operators.graph import LabeledGraph
from orbweaver.operators.rules import apply_binary, apply_unit, epsilon_edges, merge_edges, new_edges
from orbweaver.operators.statistics import degrees, edge_count, interval_plan, label_counts, next_pair, pair_weights, running_sum, vertex_intervals
from orbweaver.plans.grammar import Rule
from pyspark.sql import functions as F

SCHEMA = "src long, label string, dst long"


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rules(spark):
    assert rows(epsilon_edges(spark.range(3), [Rule("A"), Rule("B")])) == [(v, a, v) for v in range(3) for a in "AB"]
    assert rows(epsilon_edges(spark.range(3), [])) == []
    assert rows(apply_unit(edges(spark, (0, "B", 1), (1, "C", 2)), [Rule("A", "B"), Rule("D", "B")])) == [(0, "A", 1), (0, "D", 1)]
    e = edges(spark, (0, "B", 1), (1, "C", 2), (1, "B", 3))
    assert rows(apply_binary(e, e, [Rule("A", "B", "C")])) == [(0, "A", 2)]
    assert rows(apply_binary(e, e, [])) == rows(apply_unit(e, [])) == []


def test_sets(spark):
    a, b = edges(spark, (0, "B", 1), (0, "B", 1), (1, "B", 2)), edges(spark, (0, "B", 1))
    assert rows(merge_edges(a, b)) == [(0, "B", 1), (1, "B", 2)]
    assert rows(new_edges(a, b)) == [(1, "B", 2)]
    assert rows(new_edges(a.limit(0), b)) == []


def test_graph(spark):
    g = LabeledGraph.from_dataframe(edges(spark, (0, "a", 1), (0, "a", 1), (2, "b", 0)), 4)
    assert g.edges.count() == 2 and g.vertices.count() == 4
    assert rows(g.with_inverses(["a"]).edges) == [(0, "a", 1), (1, "-a", 0), (2, "b", 0)]
    g.validate(["a", "b"])
    for bad, labels in ((edges(spark, (0, "a", 9)), None), (edges(spark, (0, None, 1)), None), (edges(spark, (0, "z", 1)), ["a"])):
        with pytest.raises(ValueError):
            LabeledGraph.from_dataframe(bad, 4).validate(labels)
    assert rows(LabeledGraph.from_dataframe(edges(spark, (5, "a", 7))).vertices) == [(5,), (7,)]


def test_bits(spark):
    df = spark.createDataFrame([(v,) for v in (0, 31, 32, 191, 192, 1000)], "v long")
    places = df.select("v", bits.base_of("v").alias("b"), bits.unit_of("v").alias("u"), bits.bit_of("v").alias("k"))
    assert [tuple(r) for r in places.orderBy("v").collect()] == [(v, v // 192, v % 192 // 32, v % 32) for v in (0, 31, 32, 191, 192, 1000)]
    assert places.where(bits.vertex_of("b", "u", "k") != F.col("v")).count() == 0
    words = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (12, 2, 3), (8, 1, 4)], "w int, n int, f int")
    assert words.where((bits.bits_set("w") != F.col("n")) | (bits.first_bit("w") != F.col("f"))).count() == 0
    assert spark.range(1).select(bits.round_up(F.lit(33), 32)).first()[0] == 64


def test_statistics(spark):
    e = edges(spark, (0, "a", 1), (0, "a", 2), (0, "a", 500), (0, "b", 1), (3, "a", 0))
    assert rows(label_counts(e)) == [("a", 4), ("b", 1)]
    assert rows(edge_count(e)) == [(5,)]
    assert rows(degrees(e)) == [(0, 4, 3), (3, 1, 1)]
    by = degrees(e.withColumn("region", F.when(F.col("label") == "a", "old").otherwise("new")), "region").select("src", "region", "n_edges")
    assert rows(by) == [(0, "new", 1), (0, "old", 3), (3, "old", 1)]


def test_running_sum_over_many_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    got = [r["upto"] for r in running_sum(df, "id", "x", "upto").orderBy("id").collect()]
    total, want = 0, []
    for k in range(1000):
        total += k % 7
        want.append(total)
    assert got == want


def test_intervals_and_pairs(spark):
    e = edges(spark, *((k, "a", (k * 7 + 3) % 40) for k in range(40)))
    intervals = vertex_intervals(e, spark.range(40), 10)
    assert rows(interval_plan(intervals)) == [(p, 10 * p, 10 * p + 9, 10) for p in range(4)]
    weights = {}
    for k in range(40):
        p, q = k // 10, (k * 7 + 3) % 40 // 10
        if p != q:
            weights[p, q] = weights.get((p, q), 0) + 1
    assert rows(pair_weights(e, intervals)) == sorted((p, q, n) for (p, q), n in weights.items())
    both = {}
    for (p, q), n in weights.items():
        both[min(p, q), max(p, q)] = both.get((min(p, q), max(p, q)), 0) + n
    best = min(both, key=lambda k: (-both[k], k))
    assert rows(next_pair(pair_weights(e, intervals))) == [(*best, both[best])]
