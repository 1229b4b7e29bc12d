import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweaver.llm import ann, embed_dedup


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


ODD = [(9001, None), (9002, [0.0] * 6), (9003, [float("nan")] + [1.0] * 5), (9004, [None] + [1.0] * 5), (9005, []), (9006, [1e30] * 6), (9007, [1.0] * 6), (9008, [1e-30] * 6), (9009, [float("inf")] * 6)]


ODD[5], ODD[7] = ((k, np.array(v, "f4").astype("f8").tolist()) for k, v in (ODD[5], ODD[7]))


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, 0.0) for k, v in rows], "vec_id long, embedding array<float>, n int, score double")


def clustered(n, spreads, size=6, centres=30):
    draw = np.random.default_rng(0)
    at = draw.standard_normal((centres, size))
    return [(k, (at[k % centres if k % 3 else 0] + draw.standard_normal(size) * draw.choice(spreads)).astype("f4").tolist()) for k in range(n)]


def plain_links(rows, least):
    good = [(k, np.array(v, "f8")) for k, v in rows if usable(v)]
    keys, x = [k for k, _ in good], [v for _, v in good]
    n, out, low = [np.linalg.norm(v) for v in x], {k: 0 for k, _ in rows}, {k: k for k, _ in rows}
    near = np.array([[i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] / (n[i] * n[j]) >= least for j in range(len(x))] for i in range(len(x))])
    label = np.array(keys)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(keys))])
        if (new == label).all():
            break
        label = new
    for k, c, m in zip(keys, label.tolist(), near.sum(1).tolist(), strict=True):
        out[k], low[k] = m, c
    return {(k, out[k], low[k], low[k] == k) for k, _ in rows}


@pytest.mark.parametrize(("cells", "block"), [(embed_dedup.CELLS, 4096), ((60,), 25), ((20, 60, 300), 40)])
def test_links(spark, cells, block):
    rows = clustered(700, [0, 0.05, 0.4]) + ODD
    got = [tuple(r) for r in embed_dedup.dedup(frame(spark, rows), cells=cells, block=block).collect()]
    assert len(got) == len(rows) and set(got) == plain_links(rows, 0.95)


def test_sql_says_the_same(tmp_path, spark):
    rows = clustered(200, [0, 0.05, 0.4]) + ODD
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert set(con.sql(embed_dedup.oracle()).fetchall()) == plain_links(rows, 0.95)


def test_cells_prune_and_lose_nothing(spark):
    rows = clustered(600, [0.01], size=3, centres=60)
    rows_, vectors = embed_dedup.distinct(frame(spark, rows))
    points = embed_dedup._pivots(vectors, 3, vectors.count(), (30,), 1024, 0.1)
    dealt = embed_dedup._dealt(vectors, 3, points, 0.1, np.full(len(points), 2.0))
    assert len(points) > 10 and dealt.count() < 0.3 * vectors.count() * len(points)
    assert {tuple(r) for r in embed_dedup.dedup(frame(spark, rows), least=0.995, cells=(30,), block=10).collect()} == plain_links(rows, 0.995)


def test_parallel_pivots_lose_no_links(spark):
    """Scaled copies differ in direction by rounding alone: each must meet those that live in lower cells, whatever the rounding."""
    draw, split = np.random.default_rng(6), 0
    for _ in range(8):
        v = draw.standard_normal(64)
        rows = [(k, (v * (k + 1)).astype("f4").tolist()) for k in range(60)]
        _, vectors = embed_dedup.distinct(frame(spark, rows))
        pivots = embed_dedup._unit(np.array([rows[k][1] for k in (0, 2, 6)]))
        found = embed_dedup._dealt(vectors, 64, pivots, 0.3, np.full(3, 1.0)).collect()
        lives, goes = {r["rep"]: r["cell"] for r in found if r["inner"]}, {(r["rep"], r["cell"]) for r in found}
        assert all((k, low) in goes for k, own in lives.items() for low in set(lives.values()) if low <= own)
        split += len(set(lives.values())) > 1
    assert split


def test_links_of_odd_tables(spark):
    same = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0])]
    got = sorted((tuple(r) for r in embed_dedup.dedup(frame(spark, same)).collect()), key=str)
    assert got == sorted([(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (None, 3, None, None), (8, 0, 8, True), (9, 0, 9, True)], key=str)
    assert embed_dedup.dedup(frame(spark, same).limit(0)).count() == 0
    assert embed_dedup.dedup(frame(spark, ODD[:1])).count() == 1


def plain_search(rows, every, k):
    good = [(i, np.array(v, "f8")) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            found = sorted((-(x @ v), i) for i, v in good if i != q and len(v) == len(x))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def searched(df, every, k=20, **options):
    out = {}
    for r in sorted(ann.search(df, F.col("vec_id") % every == 0, k, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_search_against_brute_force(spark):
    rows = clustered(400, [0, 0.05, 0.4]) + ODD
    got, want = searched(frame(spark, rows), 20, miss=0.0), plain_search(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    few = searched(frame(spark, rows[:5]), 2)
    assert all(len(v) == 4 for v in few.values()) and all(len(v) == 20 for v in searched(frame(spark, rows[:21]), 2, shard=4).values()) and ann.search(frame(spark, rows).limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [0, 0.3, 1.0])
def test_recall(spark, scale):
    """At every size and spread of norms, one long vector included."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((3000, 32)) * np.exp(scale * draw.standard_normal((3000, 1)))
    x[7] *= 4 if scale else 1
    rows = [(k, v.astype("f4").tolist()) for k, v in enumerate(x)]
    got, want = searched(frame(spark, rows), 50, shard=1500), plain_search(rows, 50, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_prefixes():
    """Candidates are the rows with the longest common prefixes in any tree."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((300, 8))
    forest = ann.Forest(x, trees=5, bits=12)
    codes = np.empty((300, 5), np.int64)
    for t in range(5):
        codes[forest.order[t], t] = forest.codes[t]
    queries = draw.standard_normal((10, 8))
    strings = forest.strings(np.concatenate([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros((10, 1))], 1))
    for q, (found, score) in enumerate(forest.nearest(queries, x, 40, 40, 1.0)):
        assert np.allclose(score, x[found] @ queries[q])
        for length in range(12, -1, -1):
            want = np.flatnonzero((codes >> 12 - length == strings[q] >> 12 - length).any(1))
            if len(want) >= 40:
                break
        assert found.tolist() == want.tolist()
