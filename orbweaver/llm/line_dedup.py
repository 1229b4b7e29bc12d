"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's frequency is the number of the host's pages that contain it, divided by the number
of the host's pages; lines above the ratio that LEAST pages contain are boilerplate and are dropped from every page of the
host. The rule is the same for hosts of any size: what fewer pages share is no boilerplate. Lines count once a page,
however often they occur in it; lines of blanks only are never counted or dropped. All that remains keeps its order, and a
page none of whose lines is dropped keeps its text as it is.

Only hashes of lines are shuffled (two 64-bit hashes), summed on the map side first, so that neither a host with a third
of all pages nor a very common line gathers in one task. A host has at most (lines of its average page / ratio)
boilerplate lines; their lists are broadcast if they are few in all (BROADCAST_LINES), and else joined by host, where
Spark splits a host with very many pages. A page's lines are looked up in its host's list as a hash set.

With `copies`, copies of a page do not vote its content away: a host has as many pages as different texts, and of the
lines that are frequent among these each is counted again, once for each different rest that pages have without their
frequent lines. A page whose rest has less than the share REST of its characters does not count: it is a copy or a near
copy of others, or nearly all frame; two pages of which eight ninths are the same are near copies for the pipeline. Its
boilerplate lines are dropped like those of other pages.

A null text counts as a page without lines and stays null; an empty one stays empty. Pages with a null host are one host.
Repeated rows are pages of their own. An empty table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Share of a host's pages above which a line is boilerplate, and the least pages that contain it.
RATIO, LEAST = 0.05, 3
#: Of a page's characters the least share outside frequent lines with which it counts, where copies are told apart.
REST = 0.25
#: Boilerplate lines in all up to which the lists are broadcast.
BROADCAST_LINES = 100_000


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case, without port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, copies: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(host, line: the line's two hashes) of every line to drop."""
    page = df.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _hash))
    number = F.count_distinct("page") if copies else F.count("*")
    own = [F.xxhash64("text").alias("page")] if copies else []
    counts = page.select("host", *own, F.explode(lines).alias("line")).groupBy("host", "line").agg(number.alias("n"))
    totals = written(page.select("host", *own).groupBy("host").agg(number.alias("total")), "hosts")

    def frequent(counts: DataFrame) -> DataFrame:
        often = counts.where(F.col("n") >= least).withColumnRenamed("host", "of")
        return often.join(totals, F.col("of").eqNullSafe(F.col("host")) & (F.col("n") > F.lit(ratio) * F.col("total"))).select("host", "line")

    found = frequent(counts)
    if not copies:
        return found
    listed = _listed(page, written(found, "frequent"), "host", "text", broadcast_lines).where("__bad is not null and text is not null")
    split = listed.select("host", "text", "__bad", F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("all"))
    split = split.withColumn("__hits", _hits(F.col("all"))).withColumn("rest", F.array_join(_kept(F.col("all")), "\n"))
    split = split.where(F.length("rest") >= REST * F.length(F.array_join("all", "\n")))
    held = F.filter("__bad", lambda x: F.array_contains(F.col("__hits"), x["a"]))
    votes = split.select("host", F.xxhash64("rest").alias("rest"), F.explode(held).alias("line"))
    return frequent(votes.groupBy("host", "line").agg(F.count_distinct("rest").alias("n")))


def _listed(df: DataFrame, found: DataFrame, host: str, text: str, broadcast_lines: int) -> DataFrame:
    """df with the lines found for its host as __bad, null where there are none."""
    lists = found.groupBy("host").agg(F.collect_list("line").alias("__bad")).withColumnRenamed("host", "__of")
    if found.limit(broadcast_lines + 1).count() <= broadcast_lines:
        return df.join(F.broadcast(lists), df[host].eqNullSafe(F.col("__of")), "left")
    return df.join(lists.hint("merge"), df[host].eqNullSafe(F.col("__of")), "left")


def _hits(lines: Column) -> Column:
    """The hashes of those of a page's lines that are likely in its host's list; arrays of numbers meet as hash sets."""
    return F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.transform("__bad", lambda x: x["a"]))


def _kept(lines: Column) -> Column:
    """The lines that are not in the host's list, given __hits."""
    return F.filter(lines, lambda x: ~(F.array_contains(F.col("__hits"), F.xxhash64(x)) & F.array_contains(F.col("__bad"), _hash(x))))


def drop_boilerplate(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, n_lines: str | None = None, n_dropped: str | None = None, broadcast_lines: int = BROADCAST_LINES, copies: bool = False
) -> DataFrame:
    """df without boilerplate lines, and with the numbers of lines before and of those dropped, if names are given."""
    found = written(boilerplate(df, host, text, ratio, least, copies, broadcast_lines), "boilerplate")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    joined = _listed(df, found, host, text, broadcast_lines).withColumn("__hits", _hits(lines))
    kept = F.when(F.size("__hits") > 0, _kept(lines)).otherwise(lines)
    names = [c for c in df.columns if c not in (n_lines, n_dropped)]
    joined = joined.select(*(F.col(f"`{c}`") for c in names), F.when(F.col("__bad").isNotNull() & F.col(f"`{text}`").isNotNull(), kept).alias("__kept"))
    size = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = [F.when(F.size("__kept") < size, F.array_join("__kept", "\n")).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    if n_lines:
        out.append(size.alias(n_lines))
    if n_dropped:
        out.append(F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(size - F.size("__kept")).cast("long").alias(n_dropped))
    return joined.select(*out)


def oracle(ratio: float = RATIO, least: int = LEAST) -> str:
    """DuckDB SQL for doc_id, text, n_lines and n_dropped of documents with their sources as hosts."""
    return f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT c.source, c.line FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE c.n >= {least} AND c.n > {ratio}::DOUBLE * n.total),
marked AS (SELECT l.*, bad.line IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line),
kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN k.text END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped FROM documents d LEFT JOIN kept k USING (doc_id)
"""
