"""Tables that a job writes for itself, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. Only a local session may leave the setting out; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quarkflow-"))
    return f"{base.rstrip('/')}/quarkflow-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: lineage is cut, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
