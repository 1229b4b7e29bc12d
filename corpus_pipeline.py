"""From raw documents to token ids: language, boilerplate lines, near copies, source weights, encoding.

Each stage takes the columns of documents (doc_id, text, lang, source, n_chars) and works on all that its predecessor
kept; all but the last return these columns.

- language: documents in which no language is found, or that it does not explain, go; lang is the language found.
- lines: lines on more than a twentieth of a source's documents are taken out of its texts; every document stays. Copies
  and near copies of a document count once or not at all, so that they do not take out their content.
- near_copies: of each group of texts that share four fifths of their five-word shingles, the smallest doc_id stays; null
  and blank texts are one group.
- mix: a row for each time that the mix takes words of a document, with those words.
- encode: the token ids of every row, their number, and as its text what the ids decode to.

Null texts have no language and go in the first stage. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweaver.llm import bpe, langid, line_dedup, mixing, near_texts
from orbweaver.llm.runtime import drop_written, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the texts as they now are."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.drop_boilerplate(docs, copies=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.mix(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.verified(docs.select(*COLUMNS), vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL has no string kernels, fingerprints or byte-pair merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        now = written(stage(spark, docs, sf_dir), name)
        drop_written(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)
