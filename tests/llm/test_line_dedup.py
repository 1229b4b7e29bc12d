from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbweaver.llm import line_dedup


def plain(rows, ratio, least):
    total, seen = Counter(h for _, _, h in rows), Counter()
    for _, t, h in rows:
        for line in {x for x in (t or "").split("\n") if x.strip(" ")} if t is not None else ():
            seen[h, line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for k, t, h in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (h, x) not in bad]
        out.append((k, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def made():
    rows = [(k, "\n".join(["menu", f"own {k}", "", "menu" if k % 2 else "x", "rare" if k % 40 == 0 else f"more {k}"]), f"h{k % 3}") for k in range(150)]
    rows += [(1000 + k, "menu\nsmall", "few") for k in range(5)]
    rows += [(2000, None, "h0"), (2001, "", "h0"), (2002, "\n", "h1"), (2003, "menu\n" * 5000 + "end", "h0"), (2004, "menu", "h0"), (2004, "menu", "h0")]
    return rows + [(3000 + k, "footer\nq" + str(k), None) for k in range(25)] + [(None, "menu\nz", "h2")]


@pytest.mark.parametrize("broadcast_lines", [100_000, 0])
@pytest.mark.parametrize(("ratio", "least"), [(0.05, 3), (0.6, 1)])
def test_against_plain(spark, ratio, least, broadcast_lines):
    df = spark.createDataFrame([(*r, "clash") for r in made()], "doc_id long, text string, host string, line string")
    got = line_dedup.drop_boilerplate(df, "host", "text", ratio, least, "n_lines", "n_dropped", broadcast_lines)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == plain(made(), ratio, least)


def test_empty_and_host_of(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.drop_boilerplate(df).count() == 0
    urls = ["https://User:pw@WWW.Example.com:80/a?b#c", "http://a.b", "no url", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host_of(F.col("u")).alias("h")).collect()
    assert [r["h"] for r in got] == ["www.example.com", "a.b", "", None]


@pytest.mark.parametrize("broadcast_lines", [100_000, 0])
def test_copies_do_not_vote_their_content_away(spark, broadcast_lines):
    own = lambda k: [f"line {j} of page {k} has words of its own" for j in range(6)]
    rows = [(k, "\n".join(["the footer of all pages", *own(k)]), "h") for k in range(60)]
    rows += [(100 + k, "\n".join(own("copied")), "h") for k in range(40)]
    near = own("near")
    rows += [(200 + k, "\n".join([*near[: k % 6], f"changed line {k}", *near[k % 6 + 1 :]]), "h") for k in range(40)]
    rows += [(300 + k, "\n".join(own(f"small {k // 2}")), "small") for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, copies=True, broadcast_lines=broadcast_lines).collect()}
    assert got == {k: t.removeprefix("the footer of all pages\n") for k, t, _ in rows}


@pytest.mark.parametrize("n", [2, 3, 19, 20, 61])
def test_one_rule_at_every_size(spark, n):
    """A line that all pages of a host share is boilerplate from three pages on."""
    df = spark.createDataFrame([(k, f"shared\nown {k}", "h") for k in range(n)], "doc_id long, text string, source string")
    assert {r["text"] for r in line_dedup.drop_boilerplate(df).collect()} == {f"own {k}" if n >= 3 else f"shared\nown {k}" for k in range(n)}
