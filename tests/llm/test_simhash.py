import re

import numpy as np
import pytest
import xxhash

from orbweaver.llm import graph, near_texts, simhash


def plain(text, words=3, seed=42):
    parts = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] if len(parts) >= words else [" ".join(parts)] if parts else []
    tally = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed)
        for b in range(64):
            tally[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * tally[b] > len(shingles))


def joined(keys, links):
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def near(fps, distance):
    keys = sorted(fps)
    values = np.array([fps[k] for k in keys], np.uint64)
    return joined(keys, [(keys[i], keys[j]) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance).tolist() if j > i])


TEXTS = [None, "", " \t\n", "One", "one", "One two", "a b c", "a  b c d É é", "A B C D E F " * 30, "a b c d e f " * 30 + "g", "x" * 50000, "w " * 30000]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) % (1 << 64) == plain(t)
        assert simhash.fingerprint(t, 5) % (1 << 64) == plain(t, 5)


def test_groups_of_documents(spark):
    rows = [(10 + k, t, 0) for k, t in enumerate(TEXTS)] + [(5, "a b c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    want = near({k: plain(t) for k, t, _ in rows}, 2)
    got = {r["doc_id"]: r for r in simhash.components_of(df).collect()}
    assert all((got[k]["fingerprint"], got[k]["component_id"]) == (f"{plain(t):016x}", want[k]) for k, t, _ in rows)
    assert simhash.components_of(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "other words here")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash.components_of(odd).collect()), key=str) == [(3, 3), (3, 3), (None, None)]


def test_large_postings(spark):
    draw = np.random.default_rng(0)
    base = draw.integers(-(2**62), 2**62, 20)
    values = []
    for k in range(2500):
        x = int(base[k % 20]) if k % 3 else int(base[0])
        for _ in range(draw.integers(0, 6)):
            x ^= 1 << int(draw.integers(0, 12 if k % 2 else 64))
        values.append((x + (1 << 63)) % (1 << 64) - (1 << 63))
    want = near({k: x % (1 << 64) for k, x in enumerate(values)}, 2)
    df = spark.createDataFrame(list(enumerate(values)), "key long, fp long")
    for crowd in (simhash.CROWD, 100, 1):  # whole, and dealt anew by more positions
        assert {r["key"]: r["component_id"] for r in simhash.near_groups(df, crowd=crowd).collect()} == want


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_other_distances(spark, distance):
    draw = np.random.default_rng(distance)
    base, rows = draw.integers(-(2**62), 2**62, 4), {}
    for k in range(500):
        x = int(base[k % 4])
        for _ in range(draw.integers(0, 9)):
            x ^= 1 << int(draw.integers(0, 64))
        rows[k] = (x + (1 << 63)) % (1 << 64) - (1 << 63)
    want = near({k: x % (1 << 64) for k, x in rows.items()}, distance)
    got = simhash.near_groups(spark.createDataFrame(sorted(rows.items()), "key long, fp long"), distance).collect()
    assert {r["key"]: r["component_id"] for r in got} == want


def test_keep_one(spark):
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(draw.choice(words, 300)) for _ in range(30)]
    rows = [(k, t, "key") for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:10]):
        parts = t.split()
        parts[40], parts[200] = "other", "words"
        rows += [(100 + k, " ".join(parts), "key"), (200 + k, t, "key")]
    rows += [(None, texts[0], "key"), (None, texts[0], "key")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    kept = near_texts.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*range(30), None, None], key=str)


def test_components(spark):
    draw = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(1500, 1600)] + [(7, 7)]
    want = joined({x for e in links for x in e}, links)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in want.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
