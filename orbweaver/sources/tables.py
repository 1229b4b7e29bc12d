"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where none is set and there is one machine (tests).

    RuntimeError on a cluster without the setting, where each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='orbweaver-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of a few rows, by Arrow: a list would go through Python workers on the executors."""
    kinds = StructType.fromDDL(schema)
    columns = [*zip(*rows, strict=True)] or [()] * len(kinds)
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kinds)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one."""
    return f"{shared_dir(spark)}/orbweaver-{spark.sparkContext.applicationId}"


def drop_all(spark: SparkSession) -> None:
    """Remove every table that this application has left in the shared folder.

    Results read such tables, so that they survive lost executors: save what is still wanted first.
    """
    remove(spark, own_dir(spark))


#: Spark removes what a query shuffled at its end, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a Parquet table in the shared folder: it cuts the lineage, and a lost executor loses nothing of it.

    What was shuffled for it goes at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Remove a table that written() made and that no plan reads any more."""
    if path := getattr(df, "_written_at", None):
        remove(df.sparkSession, path)
