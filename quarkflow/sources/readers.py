"""Sources: Parquet, CSV, JSON and score tables, listings, and an optional source for columnar event files.

Listings go through Spark's file index, so any file system that Spark reads will do; only default_path() looks at local
folders. Pickled tables are not read: they run code on load and cannot be split.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarkflow.sources.sinks import exists


def read_tables(spark: SparkSession, path: str, extension: str = "parquet", name_part: str | None = None, recursive: bool = False, skip_empty: bool = True) -> DataFrame:
    """Rows of a file, or of the folder's files with that extension whose name holds name_part."""
    reader = spark.read.option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", str(recursive).lower())
    load = {"parquet": reader.parquet, "json": reader.option("multiLine", True).json, "csv": reader.option("header", True).option("inferSchema", True).csv}
    if extension not in load:
        raise ValueError(f"no reader for .{extension}")
    df = load[extension](path)
    if name_part:
        df = df.where(F.contains(F.col("_metadata.file_name"), F.lit(name_part)))
    return df.where(F.col("_metadata.file_size") > 0) if skip_empty else df


def list_files(spark: SparkSession, path: str, extension: str | None = None, name_part: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of files in order of path; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension.lstrip('.')}")
    df = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if name_part:
        df = df.where(F.contains(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(name_part)))
    return df.orderBy("path")


def entry_counts(df: DataFrame, max_events: int | None = None) -> DataFrame:
    """(file, n): rows of each file, at most max_events."""
    n = F.count(F.lit(1))
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg((n if max_events is None else F.least(n, F.lit(max_events))).alias("n"))


def capped(df: DataFrame, max_events: int, *order: str) -> DataFrame:
    """The first max_events rows of each file; the rank limit works before the exchange too."""
    w = Window.partitionBy("_file").orderBy(*order)
    return df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_events).drop("_file", "_r")


def branch(df: DataFrame, name: str) -> DataFrame:
    """One array column as flat values: only that column is read."""
    return df.select(F.explode(name).alias(name))


def branches(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def collection(df: DataFrame, prefix: str, name: str, required: tuple[str, ...] = ()) -> DataFrame:
    """df with the aligned arrays prefix_* zipped into one array of structs; absent required fields are an error."""
    columns = branches(df, f"{prefix}_")
    missing = [c for c in required if f"{prefix}_{c}" not in columns]
    if missing:
        raise ValueError(f"{prefix} lacks {', '.join(missing)}")
    return df.withColumn(name, F.arrays_zip(*(F.col(c).alias(c[len(prefix) + 1 :]) for c in columns)))


def read_sweep(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, one JSON object per file; keys that a run lacks are NULL."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def default_path(path: str | None, folder: str, spark: SparkSession | None = None) -> str:
    """path; folder for None; path below folder if only that exists; else an error. With a session paths may be in any store that Spark reads."""
    there = os.path.exists if spark is None else lambda p: exists(spark, p)
    if path is None:
        return folder
    if there(path):
        return path
    if there(below := f"{folder.rstrip('/')}/{path}"):
        return below
    raise FileNotFoundError(path)


def entry_ranges(n: int, workers: int) -> list[tuple[int, int]]:
    """n entries cut into even ranges."""
    cuts = [i * n // workers for i in range(workers + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class EventFileReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        import uproot

        self.open, self.schema = uproot.open, schema
        self.path, self.tree, self.workers = options["path"], options.get("tree", "Events"), int(options.get("workers", "8"))
        self.most = int(options["maxEvents"]) if "maxEvents" in options else None

    def partitions(self) -> list[_Range]:
        with self.open(self.path) as f:
            n = f[self.tree].num_entries
        return [_Range(self.path, a, b) for a, b in entry_ranges(n if self.most is None else min(n, self.most), self.workers)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with self.open(part.path) as f:
            arrays = f[self.tree].arrays(self.schema.names, entry_start=part.start, entry_stop=part.stop, library="np")
        for i in range(part.stop - part.start):
            yield tuple(v.tolist() if hasattr(v := arrays[c][i], "tolist") else v for c in self.schema.names)


class EventFiles(DataSource):
    """spark.read.format("event_file").schema(...).option("path", ...): entry ranges of a ROOT tree, where uproot is installed."""

    @classmethod
    def name(cls) -> str:
        return "event_file"

    def reader(self, schema: StructType) -> EventFileReader:
        return EventFileReader(self.options, schema)
