import zlib

import numpy as np

from orbweaver.llm import langid

WORDS = {"aa": ["kata", "tako", "kito", "taki"], "bb": ["blor", "brul", "lorb", "rulb"], "cc": ["sész", "zész", "ésés", "szez"]}


def made(n, seed=0):
    draw = np.random.default_rng(seed)
    return [(k, " ".join(draw.choice(WORDS[lang], 12)), lang) for k, lang in ((k, sorted(WORDS)[k % 3]) for k in range(n))]


def kernel(a, b):
    """Presence of 1- to 3-grams of the letters and blanks of two texts."""

    def grams(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / np.sqrt(len(x) * len(y))


def test_presence_is_the_kernel():
    texts = [t for _, t, _ in made(6)] + ["Kata, 3 KATA!"]
    marks = np.zeros((len(texts), (1 << langid.SHORT) + (1 << langid.LONG)))
    for row, t in zip(marks, texts, strict=True):
        row[langid.grams(t)] = 1
    ours = marks @ marks.T / np.sqrt(np.outer(marks.sum(1), marks.sum(1)))
    assert np.allclose(ours, [[kernel(a, b) for b in texts] for a in texts])


def test_scores_are_the_regression_on_landmarks():
    rows = [(lang, t) for _, t, lang in made(30)]
    model = langid.fit(rows, landmarks=4, ridge=1e-3)
    marks = [t for lang in sorted(WORDS) for t in [t for x, t in rows if x == lang][:4]]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.array([[kernel(t, m) for m in marks] for _, t in rows]) @ root
    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(sorted(WORDS)), 1.0, -1.0)
    beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 1e-3 * len(x) * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean(0)))
    new = ["kata brul lorb", "sész tako", "blor"]
    want = (np.array([[kernel(t, m) for m in marks] for t in new]) @ root - x.mean(0)) @ beta + y.mean(0)
    assert np.allclose(model.scores(new), want, atol=1e-3)


def test_held_out_accuracy(spark):
    rows = made(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    out = [k for k, _, _ in rows if got[k]["held_out"]]
    assert out and all(got[k]["lang_pred"] == rows[k][2] and 0.5 < got[k]["score"] <= 1 for k in out)


def test_edges(spark):
    rows = [(k, t, lang) for k, t, lang in made(60)] + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", None), (None, "kata tako", "aa"), (1003, "kata " * 50000, None), (1003, "blor", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "doc_id")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert not by[None]["held_out"] and by[None]["lang_pred"] == "aa"
    kept = langid.keep_known(df.selectExpr("*", "1 as score", "'x' as lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"] and kept.count() == len(rows) - 3
    assert langid.identify(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "kata", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(nothing).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_sample_is_bounded_and_learns_from_no_held_out_row(spark):
    rows = made(600)
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_class=20)
    assert len(got) == 60
    out = {t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2} - {t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert not out & {t for _, t in got}


def test_texts_in_unlearned_languages_go(spark):
    """However few languages there are, and of whichever script."""
    unlearned = ["это простой текст на языке который модель не видела", "wumpf gnidd wumpf hevvy gnidd xummy hevvy dwigg", "zq xvj qqw jxk vvq wzx qjj", "这是一个模型从未见过的中文文本应该被拒绝因为没有学过"]
    for langs in (["aa", "bb"], ["aa", "bb", "cc"]):
        rows = [r for r in made(300) if r[2] in langs] + [(1000 + k, t, None) for k, t in enumerate(unlearned)]
        kept = langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        assert {r["doc_id"] for r in kept} == {k for k, _, lang in rows if lang}
        assert all(r["lang"] == rows_lang for r in kept for k, _, rows_lang in rows if k == r["doc_id"])


def test_large_alphabets():
    """Languages of two thousand letters each, some of one script, beside small ones."""
    draw = np.random.default_rng(4)
    letters = {"x1": (0x4E00, 2000), "x2": (0x5A00, 2000), "x3": (0xAC00, 2000), "s1": (0x61, 13), "s2": (0x6E, 13)}
    words = {k: ["".join(chr(a + int(c)) for c in draw.zipf(1.2, 3) % n) for _ in range(1500)] for k, (a, n) in letters.items()}
    text = lambda k: " ".join(draw.choice(words[k], 40))
    model = langid.fit([(k, text(k)) for _ in range(100) for k in letters])
    asked = [k for _ in range(60) for k in letters]
    got, _ = model.predict([text(k) for k in asked])
    for k in letters:
        assert np.mean([g == k for g, a in zip(got, asked, strict=True) if a == k]) >= 0.95


def test_ties_and_clashing_columns(spark):
    """Texts of no learned n-gram score alike in languages of equal shares: the first is taken, each time."""
    rows = [(k, t, lang, True, 0.5) for k, t, lang in made(60)] + [(900 + k, "жжж", None, False, 0.1) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean, score double")
    got = langid.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert len({(r["lang_pred"], r["score"]) for r in got.where("doc_id >= 900").collect()}) == 1
    model = langid.fit([("b", "kata tako"), ("a", "kata tako")])
    assert model.predict(["kata", "zzz"])[0] == ["a", "a"]
