import re

from orbweaver.llm import license_scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words_of(text)
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))


def scan(spark, documents, **options):
    df = spark.createDataFrame([(k, t, "clash", 0.5) for k, t in enumerate(documents)], "doc_id long, text string, label string, p double")
    return [r for r in sorted(license_scan.scan(df, **options).collect(), key=lambda r: r["doc_id"])]


MIT, GPL = license_scan.TEMPLATES["mit-text"], license_scan.TEMPLATES["gpl-notice"]


def test_base_places(spark):
    texts = [None, "", "!!!", "MIT License", "mit license mit license", "the M.I.T. license; Mit\n\tLICENSE", "gnu general public gnu general public license", "CC BY-NC cc-by", "ÉMIT license é mit license",
             "apache", "Apache License", "apache license " * 2000 + "end", MIT, GPL, "K mit İ license", "cc by"]
    got = scan(spark, texts)
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] == [base(t) for t in texts]
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def labels(r):
    return set(r["labels"].split(",")) - {""}


def test_spans_survive_edits(spark):
    w = MIT.split()
    edited = " ".join(w[:10] + ["really", "inserted"] + w[10:25] + w[27:])
    texts = [f"intro {MIT} outro", edited, " ".join(w[:12]), " ".join(reversed(w)), f"{MIT} some words {GPL}", "plain of the and to words " * 300]
    got = scan(spark, texts)
    assert [labels(r) & {"mit-text", "gpl-notice"} for r in got] == [{"mit-text"}, {"mit-text"}, set(), set(), {"mit-text", "gpl-notice"}, set()]
    assert got[0]["score"] == 1.0 and 0.6 <= got[1]["score"] < 1.0 and got[3]["score"] == 0.0


def test_diagonals_against_brute_force(spark):
    """Every span found has the votes and bounds that a plain count of its diagonals gives."""
    text = "x y " + " ".join(GPL.split()[:14]) + " z z " + " ".join(GPL.split()[14:])
    doc, template = words_of(text), words_of(GPL)
    votes = sum(doc[p : p + 2] == template[q : q + 2] for p in range(len(doc) - 1) for q in range(len(template) - 1) if p - q in (2, 4))
    (r,) = scan(spark, [text], texts={"gpl-notice": GPL}, phrases={})
    assert r["labels"] == "gpl-notice" and r["score"] == votes / (len(template) - 1)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id long, text string")
    assert license_scan.scan(df).count() == 3 and license_scan.scan(df.limit(0)).count() == 0


def test_against_sql(spark):
    """All columns, over documents with base phrases, whole and edited templates, null texts and repeated rows."""
    import duckdb
    import pandas as pd

    w = MIT.split()
    texts = [None, "", "mit license cc by", f"intro {MIT} and {GPL} {GPL}", " ".join([*w[:10], "really", "inserted", *w[10:25], *w[27:]]), "Released under the MIT License. " * 4, "É mit license", *license_scan.TEMPLATES.values()]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, "mit license"), (3, "mit license")]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": pd.array([k for k, _ in rows], "Int64"), "text": [t for _, t in rows]}))
    con.sql("CREATE TABLE documents AS SELECT * FROM given")
    assert sorted(got, key=str) == sorted(con.sql(license_scan.oracle()).fetchall(), key=str)
    assert license_scan.TEMPLATES.keys() <= {x for r in got for x in r[6].split(",")}


def dealt(plan):
    """Rows that each shuffle of an executed plan wrote."""
    while plan.nodeName() == "AdaptiveSparkPlan" or plan.nodeName().endswith("QueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    below = plan.children()
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
    return own + [n for k in range(below.size()) for n in dealt(below.apply(k))]


def test_lone_votes_are_not_dealt_again(spark):
    """Common pairs give diagonals of one vote; only the texts' own rows and diagonals that can count go on to the spans."""
    lone = ("of the " + "zz " * 400) * 5
    rows = [*((k, lone) for k in range(40)), (40, MIT), *[(41, lone)] * 3, *[(42, MIT)] * 3]
    df = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = df.collect()
    assert sorted((r["doc_id"], r["labels"], r["score"] == 1) for r in got) == sorted((k, "mit-text" if t == MIT else "", t == MIT) for k, t in rows)
    second, first = sorted(dealt(df._jdf.queryExecution().executedPlan()))
    assert first > 40 * 5 * 5 and second < 3 * len(rows) + 50
