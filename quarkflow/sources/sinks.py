"""Sinks: Parquet tables with a completion check, CSV, scores and run summaries.

A folder counts as complete when Spark's committer has left _SUCCESS in it. Paths go through Hadoop's file system of
the session, so they may be in any store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def write_table(df: DataFrame, path: str, *partition_by: str, sort_by: str | None = None) -> None:
    """Parquet; rows sorted by a scalar such as fj_pt let readers skip row groups."""
    df = df.sortWithinPartitions(sort_by) if sort_by else df
    df.write.partitionBy(*partition_by).parquet(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless a complete table is there (False then); a partial one is an error."""
    spark = df.sparkSession
    if is_complete(spark, path):
        return False
    if exists(spark, path):
        raise FileExistsError(f"{path} holds a partial output")
    df.write.parquet(path)
    return True


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_scores(df: DataFrame, path: str, id_col: str, label: str, score: str) -> None:
    df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score")).write.parquet(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """One JSON object."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(summary, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def move_used(spark: SparkSession, path: str, folder: str = "used") -> str:
    """Move a consumed input into a folder beside it; returns the new path."""
    fs, p = _fs(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), folder)
    fs.mkdirs(target)
    to = spark._jvm.org.apache.hadoop.fs.Path(target, p.getName())
    if not fs.rename(p, to):
        raise OSError(f"{path} could not be moved")
    return to.toString()
