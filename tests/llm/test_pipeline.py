from collections import Counter

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from orbweaver.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    draw = np.random.default_rng(0)
    words = {"aa": [f"ka{c}ta" for c in "bcdfghjklmnp"], "bb": [f"blo{c}r" for c in "bcdfghjklmnp"]}
    rows = []
    for k in range(160):
        lang = "ab"[k % 2] * 2
        lines = [" ".join(draw.choice(words[lang], 12)) for _ in range(6)]
        if k % 4 == 0:
            lines.insert(3, "all pages have this")
        rows.append((k, "\n".join(lines), lang, f"src{k % 3}"))
    rows += [(500 + k, rows[k][1] if k % 2 else rows[k][1] + " kabta", rows[k][2], "src9") for k in range(10)]
    return rows + [(900, None, "aa", "src0"), (901, "12 !!", "aa", "src1"), (902, "", None, None), (903, "katka " * 3000, None, None)]


def frame(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in made()], SCHEMA)


def test_stages(spark):
    docs, stages = frame(spark), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_copies", "mix", "encode"]
    found = stages["language"](spark, docs, "")
    assert found.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in found.collect()} == {900, 901, 902}
    assert all(r["lang"] == k for r in found.collect() for j, _, k, _ in made() if j == r["doc_id"] and k)
    lines = stages["lines"](spark, found, "")
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert len(texts) == found.count() and lines.columns == docs.columns
    assert all("all pages" not in t for k, t in texts.items() if k < 160) and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    single = stages["near_copies"](spark, lines, "")
    assert {r["doc_id"] for r in single.collect()} == {*range(160), 903} and single.columns == docs.columns
    mixed = stages["mix"](spark, single, "")
    whole = Counter(w for r in single.collect() for w in r["text"].split())
    some = Counter(w for r in mixed.collect() for w in r["text"].split())
    assert mixed.columns == docs.columns and abs(sum(some.values()) / sum(whole.values()) - 1) < 0.1
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    kept, coded = Counter((r["doc_id"], r["text"]) for r in mixed.collect()), stages["encode"](spark, mixed, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in coded) == kept
    assert all(r["token_ids"] == t.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"]) for r in coded)


def test_run_is_the_stages_in_order(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_empty(spark):
    docs = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 11)) and ORACLES.keys() <= QUERIES.keys()


def test_large_group_of_copies_keeps_one(spark):
    """Copies that are more than a twentieth of a source do not empty each other."""
    draw = np.random.default_rng(1)
    line = lambda: " ".join(draw.choice([f"ka{c}ta" for c in "bcdfghjklmnp"], 12))
    same = "\n".join(line() for _ in range(6))
    rows = [(k, "\n".join(line() for _ in range(6)), "aa", "src0") for k in range(60)] + [(100 + k, same, "aa", "src0") for k in range(30)]
    docs, stages = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA), dict(corpus_pipeline.STAGES)
    single = stages["near_copies"](spark, stages["lines"](spark, docs, ""), "")
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {**{k: t for k, t, _, _ in rows[:60]}, 100: same}


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows and columns with the names that stages use inside."""
    names = ["key", "rep", "print", "digest", "component", "host", "line", "page", "score", "part", "row", "block", "token_ids", "__lang"]
    rows = [(*r, len(r[1] or "")) for r in made()]
    rows += [rows[0], rows[0], (None, rows[4][1], None, None, None), (None, rows[4][1], None, None, None), (950, rows[6][1] + "\nkabta kacta", None, None, None)]
    docs = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], SCHEMA + "".join(f", {n} int" for n in names))
    stages = dict(corpus_pipeline.STAGES)
    found = stages["language"](spark, docs, "")
    assert found.columns == docs.columns[:5] and found.count() == len(rows) - 3
    lines = stages["lines"](spark, docs, "")
    assert lines.columns == docs.columns[:5] and lines.count() == len(rows)
    single = stages["near_copies"](spark, docs, "").collect()
    # rows with equal keys go together, null keys stay
    assert Counter(r["doc_id"] for r in single)[0] == 3 and sum(r["doc_id"] is None for r in single) == 2 and 950 not in {r["doc_id"] for r in single}
    assert set(stages["mix"](spark, docs, "").columns) == set(docs.columns[:5])
    assert stages["encode"](spark, docs, "").count() == len(rows)
