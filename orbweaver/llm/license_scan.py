"""License scans by diagonal voting, in DataFrame functions only.

Every text's rolling word pairs are hashed and joined with the positions of the same hashes in license templates (the
words themselves are compared too). A hit at word p of a text and word q of a template votes for the diagonal p - q.
Votes are summed by text, template and diagonal; diagonals that lie within `slack` words of each other (words inserted
or left out) are merged into one span; and a span counts if it has `coverage` of the template's pairs and `density`
pairs to its words. The templates are a fixed table of a few hundred rows, broadcast; texts are only shuffled as votes.

Short phrases are templates too, for which one diagonal must have every vote: then the phrase's words stand at
the diagonal, consecutively. These are the base places.

Votes are counted for key and text (two hashes): rows equal in both share one count, divided by their number, and each
gives its row; no row needs a number of its own, which a second attempt might deal anew.

A null or empty text has no words, no places and empty labels. Every row of the input gives one row, repeated rows and
rows with equal or null keys too. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import local_table

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening or granting passages of well-known licenses, and their labels.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-grant": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-grant": "Licensed under CC BY-NC 4.0.",
    "gpl-grant": "This work is licensed under the GNU General Public License, version 3.",
    "mit-grant": "Released under the MIT License.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version",
    "gpl-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd-3-clause": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-body": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text) -> F.Column:
    """The words of a text, A-Z in lower case. No other character is changed."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, _NO_WORD), "")


def _pairs(words) -> F.Column:
    """Each word with the one after it; the last with null."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def templates(spark: SparkSession, phrases: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """A row for each word pair of each template, and one (template -1) that every text has."""
    rows = [(n, kind, label, t) for n, (kind, label, t) in enumerate([*(("base", v, k) for k, v in phrases.items()), *(("long", k, v) for k, v in texts.items())])]
    table = local_table(spark, rows, "template int, kind string, label string, text string").withColumn("words", _words(F.col("text")))
    pairs = table.select("template", "kind", "label", (F.size("words") - 1).alias("pairs"), F.posexplode(_pairs(F.col("words")))).where("col.b is not null")
    every = local_table(spark, [(-1, "text", "", 1, 0, "", "")], "template int, kind string, label string, pairs int, q int, a string, b string")
    return pairs.select("template", "kind", "label", "pairs", F.col("pos").alias("q"), "col.a", "col.b").union(every).withColumn("h", F.xxhash64("a", "b"))


def scan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    texts: dict[str, str] = TEMPLATES,
    slack: int = 3,
    least: int = 2,
    coverage: float = 0.6,
    density: float = 0.5,
) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's share of its template)."""
    spark = df.sparkSession
    t = F.col(f"`{text}`")
    own = ["key", "h1", "h2", "n_words"]
    words = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("text"), t).alias("h2"), _words(t).alias("words"))
    first = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = words.select("key", "h1", "h2", F.size("words").alias("n_words"), F.posexplode(F.concat(first, _pairs(F.col("words")))).alias("p", "pair"))
    pairs = pairs.select(*own, (F.col("p") - 1).alias("p"), F.col("pair.a").alias("wa"), F.col("pair.b").alias("wb")).where("wb is not null")
    table = F.broadcast(templates(spark, phrases, texts))
    hits = pairs.withColumn("wh", F.xxhash64("wa", "wb")).join(table, (F.col("wh") == F.col("h")) & (F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")))
    votes = hits.groupBy(*own, "template", "kind", "label", "pairs", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    votes = votes.where("kind = 'text' or kind = 'base' and votes >= pairs or kind = 'long' and votes >= least(pairs, %d)" % least)  # too few for all equal rows together: too few for each
    rows, along = Window.partitionBy(*own).orderBy("template", "diagonal"), Window.partitionBy(*own, "template").orderBy("diagonal")  # one sort serves both
    votes = votes.withColumn("rows", F.max(F.when(F.col("kind") == "text", F.col("votes"))).over(rows))  # the text's own row (template -1) is the first
    votes = votes.withColumn("votes", F.when(F.col("kind") == "text", 1).otherwise(F.expr("votes div rows")))
    own.append("rows")
    votes = votes.where("kind = 'text' or kind = 'base' and votes = pairs or kind = 'long' and votes >= least(pairs, %d)" % least)
    begins = (F.col("kind") != "long") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    merged = votes.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(along))
    spans = merged.groupBy(*own, "template", "kind", "label", "pairs", "span").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    spans = spans.withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("pairs")))
    base, long = F.col("kind") == "base", (F.col("kind") == "long") & (F.col("share") >= coverage) & (F.col("votes") / (F.col("last") - F.col("first") + 1) >= density)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy(*own).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first").cast("long"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base | long).alias("labels"),
        F.coalesce(F.max(F.when(base | long, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    found = found.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return found.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEMPLATES, slack: int = 3, least: int = 2, coverage: float = 0.6, density: float = 0.5) -> str:
    """DuckDB SQL for the rows of scan() over documents."""
    rows = []
    for n, (kind, label, t) in enumerate([*(("base", v, k) for k, v in phrases.items()), *(("long", k, v) for k, v in texts.items())]):
        words = re.findall("[0-9a-z]+", t.lower())
        rows += [f"({n}, '{kind}', '{label}', {len(words) - 1}, {q}, '{a}', '{b}')" for q, (a, b) in enumerate(zip(words, words[1:]))]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    good = f"kind = 'long' AND share >= {coverage} AND votes / (last - first + 1) >= {density}"
    return f"""
WITH t(template, kind, label, pairs, q, a, b) AS (VALUES {", ".join(rows)}),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_NO_WORD}'), lambda x: x <> '') AS words FROM documents),
u AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS p FROM w),
n AS (SELECT r, p, a, lead(a) OVER (PARTITION BY r ORDER BY p) AS b FROM u),
v AS (SELECT r, template, kind, label, pairs, p - q AS diagonal, count(*) AS votes, min(p) AS first, max(p) AS last FROM n JOIN t USING (a, b) GROUP BY ALL HAVING (kind = 'base' AND count(*) = pairs) OR (kind = 'long' AND count(*) >= least(pairs, {least}))),
m AS (SELECT *, CASE WHEN kind = 'long' AND diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {slack} THEN 0 ELSE 1 END AS begins FROM v),
s AS (SELECT *, sum(begins) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM m),
g AS (SELECT r, template, kind, label, pairs, span, sum(votes)::BIGINT AS votes, min(first) AS first, max(last) AS last, least(1.0::DOUBLE, sum(votes)::BIGINT / pairs) AS share FROM s GROUP BY r, template, kind, label, pairs, span),
f AS (SELECT r, count(*) FILTER (WHERE kind = 'base') AS n_base, (min(first) FILTER (WHERE kind = 'base'))::BIGINT AS first_word, (max(first) FILTER (WHERE kind = 'base'))::BIGINT AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'base' OR {good}) AS labels,
  max(share) FILTER (WHERE kind = 'base' OR {good}) AS score FROM g GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM w LEFT JOIN f USING (r)
"""
