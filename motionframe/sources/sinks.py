"""Written datasets and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, for any file system that Spark reads."""
    try:
        spark.read.schema("value string").text(path)  # resolved now, read never
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its success marker."""
    return path_exists(spark, f"{path}/_SUCCESS")


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = (), *,
                  if_exists: str = "skip") -> DataFrame:
    """Write once and read back.

    `skip` keeps a finished dataset and replaces a half-written one; `overwrite`
    replaces everything; `partitions` replaces only the partitions being written.
    """
    spark = df.sparkSession
    if if_exists == "skip" and is_complete(spark, path):
        return spark.read.parquet(path)
    writer = df.write.mode("overwrite")
    if if_exists == "partitions":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    elif if_exists not in ("skip", "overwrite"):
        raise ValueError(f"unknown if_exists: {if_exists}")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def write_summary(df: DataFrame, path: str, fmt: str = "csv", *, files: int | None = None) -> None:
    """Summary table as csv, json or parquet; `files` only for tables known to be small."""
    if files:
        df = df.repartition(files)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
