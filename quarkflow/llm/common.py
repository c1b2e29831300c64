"""What the training-data operators share: tables in the shared folder, hashing, document access."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, a laptop) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        base = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="quarkflow-"))
    return f"{base.rstrip('/')}/quarkflow-{app}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below shared_dir()."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files whose plans are gone (they count as disk until then)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id gives null."""
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(folds))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow where make() builds a task's state once and its result maps a batch, _ROWS rows at a time: so many are Python objects at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                if (out := work(batch.slice(at, _ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, text_col: str, keep: tuple[Column, ...]) -> tuple[DataFrame, list[str], str]:
    """(frame for the workers, columns to hand on, the text's column): the text goes to Python once, kept or not."""
    kept = df.select(*keep)
    names = kept.columns
    if dict(kept.dtypes).get(text_col) == "string":
        return kept, names, text_col
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")), names, "_text"


def schema_of(df: DataFrame, names: list[str], more: str) -> str:
    """DDL of some of df's columns and more."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names] + [more])


_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
