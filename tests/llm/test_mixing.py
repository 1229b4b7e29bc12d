import re
from collections import Counter

import numpy as np
import pytest

from orbweaver.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 0, 5, 100]) == pytest.approx([30, 0, 85 / 6, 425 / 6])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    sizes = np.random.default_rng(0).integers(0, 1000, 50).tolist()
    out = mixing.targets(sizes)
    assert sum(out) == pytest.approx(sum(sizes)) and all(t <= 3 * n for t, n in zip(out, sizes, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    for tweak in (0, 5):
        assert sorted(mixing.permuted(np.arange(n), n, np.full(n, tweak)).tolist()) == list(range(n))
    assert n < 64 or mixing.permuted(np.arange(n), n, np.zeros(n)).tolist() != mixing.permuted(np.arange(n), n, np.ones(n)).tolist()


def made():
    draw = np.random.default_rng(1)
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(draw.integers(0, 60))), ["b", "a", None, "Z"][int(draw.integers(0, 4)) if k % 3 else 0]) for k in range(300)]
    return rows + [(900, None, "a"), (901, "", None), (902, " \t\n", "b"), (903, "long " * 20000, "a"), (904, "x", "tiny"), (None, "n u l l", "a"), (905, "same words", "b"), (905, "same words", "b")]


def frame(spark):
    return spark.createDataFrame([(*r, 0, 1, "x") for r in made()], "doc_id long, text string, source string, block int, row long, part string")


def test_take(spark):
    got = mixing.take(frame(spark), block=16).collect()
    again = mixing.take(frame(spark).repartition(3), block=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    rows = made()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((k, size(t)) for k, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.targets([total[s] for s in order]), strict=True))
    taken, source = Counter(), {k: s for k, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(targets[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max(1, 0.02 * targets[s]) for s in order)


def replayed(rows, block, seed=0, most=3):
    """What the mix takes of each row, word by word: every source's words in blocks, each slot's block by its permutation."""
    words = {}
    for n, (k, t, s) in enumerate(rows):
        words.setdefault(s, []).append((k is not None, k, len((t or "").split()), n))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    sizes = [sum(x[2] for x in words[s]) for s in order]
    out = Counter()
    for k, (s, n, target) in enumerate(zip(order, sizes, mixing.targets(sizes), strict=True)):
        if not n:
            continue
        length = max(1, min(block, n // 256))
        blocks = -(-n // length)
        full = min(most, int(target // n))
        quota = full * blocks + (round((target - full * n) / n * blocks) if full < most else 0)
        owner = [x[3] for x in sorted(words[s], key=lambda x: (x[0], x[1] or 0, x[2])) for _ in range(x[2])]
        for slot in range(quota):
            tweak = np.array([(slot // blocks * len(order) + k) * 1_000_003 + seed], np.uint64)
            b = int(mixing.permuted(np.array([slot % blocks]), blocks, tweak)[0])
            out.update(owner[b * length : (b + 1) * length])
    return out


def test_taken_is_what_slots_say(spark):
    """Against a plain replay, and near the targets even where sources are small."""
    draw = np.random.default_rng(8)
    rows = [(1000 * k + j, " ".join("w" * int(draw.integers(1, 9)) for _ in range(n // 10)), f"s{k}") for k, n in enumerate([300, 100, 270, 5000, 40_000]) for j in range(10)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, slot string, n long")
    got = {r["doc_id"]: r for r in mixing.take(df).collect()}
    want = replayed(rows, mixing.BLOCK)
    assert {k: r["taken"] for k, r in got.items()} == {r[0]: want[n] for n, r in enumerate(rows)}
    for s in {r[2] for r in rows}:
        own = [got[r[0]] for r in rows if r[2] == s]
        assert abs(sum(r["taken"] for r in own) / own[0]["target"] - 1) < 0.05


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.take(frame(spark))


def test_mix_takes_what_take_says(spark):
    df = frame(spark)
    taken = Counter({k: 0 for k, _, _ in made()})
    for r in mixing.take(df, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mix(df, block=16)
    assert mixed.columns == df.columns
    words, texts = Counter(), {k: t for k, t, _ in made()}
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert Counter(r["text"].split()) <= Counter((texts[r["doc_id"]] or "").split())
    assert +taken == +words


def test_slots_against_the_plan(spark):
    df = frame(spark)
    plan = mixing.Plan(mixing._offsets(df, "doc_id", "text", "source", False), 16, 0, mixing.WEIGHTS, 3, 50, 1000)
    rows = mixing.slots(df, plan).collect()
    assert Counter(r["source_number"] for r in rows) == Counter({k: n for k, n in enumerate(plan.quota) if n})
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(k // 50, k % 50) for k in range(sum(plan.quota))]
    times = Counter((r["source_number"], r["block"]) for r in rows)
    for k, n in enumerate(plan.blocks):
        if plan.quota[k]:
            counts = {times[k, b] for b in range(n)}
            assert max(counts) <= 3 and max(counts) - min(counts) <= 1 and sum(times[k, b] for b in range(n)) == plan.quota[k]


def test_copies():
    text = "a  b\nc d"
    assert mixing.copies(text, [(0, 2, 2), (2, 4, 1)]) == [text, "a  b"]
    assert mixing.copies(text, [(0, 1, 1), (2, 3, 1), (3, 4, 1)]) == ["a\nc d"]


def test_empty(spark):
    assert mixing.take(frame(spark).limit(0)).count() == 0 and mixing.mix(frame(spark).limit(0)).count() == 0
