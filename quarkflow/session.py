"""A session with the settings the engine is written for; nothing in the library needs it."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution coalesces and splits partitions at run time; texts and arrays want Arrow batches of bounded bytes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "quarkflow", **settings: str) -> SparkSession:
    """The running session, or a new one with SETTINGS and settings (underscores for dots)."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
