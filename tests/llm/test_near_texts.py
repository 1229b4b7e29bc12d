import time

import numpy as np

from orbweaver.llm import near_texts

SCHEMA = "doc_id long, text string, rep string"


def plain(text):
    parts = (text or "").lower().split()
    return {" ".join(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(draw, words, least, most):
    """A copy whose similarity lies in that range."""
    while True:
        new = list(words)
        for k in range(400):
            new[draw.integers(0, len(new))] = f"new{draw.integers(0, 1 << 30)}"
            s = alike(plain(" ".join(words)), plain(" ".join(new)))
            if s < most:
                break
        if s >= least:
            return new


def scattered(draw, words, target):
    """A copy of about that similarity, words replaced here and there."""
    new, own = list(words), plain(" ".join(words))
    for j in draw.permutation(len(words)).tolist():
        old, new[j] = new[j], f"new{draw.integers(0, 1 << 30)}"
        if alike(own, plain(" ".join(new))) < target:
            new[j] = old
            return new


def appended(draw, words, target):
    """A copy of about that similarity, with words put after the end."""
    return [*words, *(f"new{draw.integers(0, 1 << 30)}" for _ in range(int((len(words) - 4) / target) - len(words) + 4))]


def test_recall_at_the_minimum(spark):
    """At 0.8 nine of ten pairs and more are found, whatever the change; none below it is taken for one."""
    draw, rows, kinds = np.random.default_rng(0), [], []
    for size in (250, 800):
        for made in (scattered, appended):
            for target in (0.8, 0.7):
                for _ in range(50):
                    words = [f"w{len(rows)}x{j}" for j in range(size)]
                    rows += [(len(rows), " ".join(words), "r"), (len(rows) + 1, " ".join(made(draw, words, target)), "r")]
                    kinds.append((size, made.__name__, target))
    kept = {r["doc_id"] for r in near_texts.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    caught = {}
    for k, kind in enumerate(kinds):
        real = alike(plain(rows[2 * k][1]), plain(rows[2 * k + 1][1])) >= 0.8
        gone = 2 * k + 1 not in kept
        assert real or not gone
        if real:
            caught.setdefault(kind, []).append(gone)
    assert 2 * len(kinds) - sum(2 * k in kept for k in range(len(kinds))) == len(kinds)
    assert sum(map(len, caught.values())) >= 150 and np.mean(sum(caught.values(), [])) >= 0.9


def test_above_the_minimum_all_are_found(spark):
    draw, rows = np.random.default_rng(5), []
    for k in range(100):
        words = [f"w{k}x{j}" for j in range(draw.integers(60, 500))]
        rows += [(2 * k, " ".join(words), "r"), (2 * k + 1, " ".join(changed(draw, words, 0.87, 0.9)), "r")]
    assert {r["doc_id"] for r in near_texts.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()} == {2 * k for k in range(100)}


def test_groups_against_brute_force(spark):
    draw, rows = np.random.default_rng(1), []
    for k in range(12):
        words = [f"w{k}x{j}" for j in range(100)]
        for _ in range(25):  # chains: each a copy of one before
            words = changed(draw, words, 0.7, draw.choice([0.78, 0.85, 0.95]))
            rows.append((len(rows), " ".join(words), "r"))
    rows += [(900, None, "r"), (901, " ", "r"), (902, "one two", "r"), (903, "ONE  two", "r"), (904, rows[7][1], "r"), (None, "one two", "r")]
    sets = {k: plain(t) for k, t, _ in rows if k is not None}
    low = {k: k for k in sets}
    near = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.8]
    for _ in range(len(sets)):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["key"]: r["component_id"] for r in near_texts.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[k] != low[k] for k in low) <= 0.02 * len(low) and len(set(low.values())) > 20


def test_large_group_of_loose_copies(spark):
    """Many of its pairs lie below the minimum, and its smallest key is like few of the others."""
    draw, rows, words = np.random.default_rng(3), [], [f"w{j}" for j in range(150)]
    for k in range(400):
        new = list(words)
        for j in draw.choice(150, int(draw.integers(0, 9)) if k else 12, replace=False):
            new[j] = f"new{k}x{j}"
        rows.append((k, " ".join(new), "r"))
    sets = [plain(t) for _, t, _ in rows]
    low = list(range(400))
    near = [(a, b) for a in range(400) for b in range(a + 1, 400) if alike(sets[a], sets[b]) >= 0.8]
    for _ in range(20):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["key"]: r["component_id"] for r in near_texts.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(low)) and len(near) < 0.8 * 400 * 399 / 2


def test_a_large_group_is_not_named_by_every_task_of_every_turn(spark, monkeypatch):
    """A text meets its group in all turns and tasks, but goes on only where it has met a smaller one than before."""
    draw, rows, made, mapped = np.random.default_rng(4), [], [], near_texts.map_batches

    def noted(df, function, schema):
        out = mapped(df, function, schema)
        if function is near_texts._meetings:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_texts, "map_batches", noted)
    words = [f"w{j}" for j in range(150)]
    for k in range(300):
        new = list(words)
        for j in draw.choice(150, 2, replace=False):
            new[j] = f"new{k}x{j}"
        rows.append((k, " ".join(new), "r"))
    rows.append((300, "some other text of seven words", "r"))
    got = {r["key"]: r["component_id"] for r in near_texts.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == dict.fromkeys(range(300), 0) | {300: 300}
    assert len(made) == 8 and 300 <= sum(made) <= (tasks + 2) * 300


def test_no_more_than_a_part_of_the_index_at_a_time(spark, monkeypatch):
    """What is dealt at once stays below a text's size however many texts met others by chance; fingerprints are not dealt with each entry."""
    draw, sizes, index = np.random.default_rng(3), [], near_texts._index

    def noted(*args):
        blobs = index(*args)
        sizes.append(blobs.selectExpr(*(f"sum(length({c})) as {c}" for c in ("texts", "counts", "low", "high", "extra"))).selectExpr("texts + counts + low + high + extra").first()[0])
        return blobs

    monkeypatch.setattr(near_texts, "_index", noted)
    rows = []
    for k in range(0, 300, 2):
        words = [f"w{k}x{j}" for j in range(100)]
        rows += [(k, " ".join(words), "r"), (k + 1, " ".join(changed(draw, words, 0.6, 0.95)), "r")]
    kept = near_texts.keep_one(spark.createDataFrame(rows, SCHEMA)).count()
    assert 150 <= kept < 300 and max(sizes) < 2000 * len(rows)


def test_written_tables_leave_no_shuffle(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    for _ in range(3):
        near_texts.drop_written(near_texts.written(spark.range(1000).repartition(3, "id"), "some"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
