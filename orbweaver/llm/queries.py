"""One query for each operator, over its whole table, and SQL where SQL can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, langid, license_scan, line_dedup, mixing, pii, simhash, vbyte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of this query alone, whose tables are made up; a caller's key is secret.
TEST_KEY = "orbweaver pseudonyms"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)


def op2_ranked_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vbyte.round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(_table(spark, sf_dir, "embeddings"))


def op4_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(documents, n_lines="n_lines", n_dropped="n_dropped").drop("source")


ORACLES["op3_pivot_range_join"] = embed_dedup.oracle()
ORACLES["op4_site_line_frequency"] = line_dedup.oracle()


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(_table(spark, sf_dir, "documents"))


def op8_string_kernel_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_simhash_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(_table(spark, sf_dir, "documents"))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


ORACLES["op10_license_diagonals"] = license_scan.oracle()

QUERIES |= {f.__name__: f for f in (op1_feistel_pseudonyms, op2_ranked_vbyte, op3_pivot_range_join, op4_site_line_frequency, op5_hash_prefix_forest, op6_segment_tree_bpe, op7_block_mixing, op8_string_kernel_lang, op9_simhash_positional, op10_license_diagonals)}
