"""Percentile scaling: one aggregate over the background's values for all features at once, then a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import INF, NAN, d, is_close, is_finite
from quarkflow.operators.stats import exact_quantiles

EPSILON = 1e-6


def long_values(df: DataFrame, features: dict[str, Column], *keep: str) -> DataFrame:
    """(keep, feature, value): features are arrays (one row per element) laid out in one pass."""

    def named(n: str, c: Column) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value")))

    pairs = F.flatten(F.array(*(named(n, c) for n, c in features.items())))
    return df.select(*keep, F.inline(pairs))


def percentile_scalers(values: DataFrame, lo: float = 0.16, hi: float = 0.84) -> DataFrame:
    """(feature, kind, p16, p84) by linear interpolation over finite non-zero values; kind `uninformative` where there are none or both are close."""
    x = F.when(is_finite(F.col("value")) & (F.col("value") != 0), F.col("value"))
    found = exact_quantiles(values.withColumn("_v", x), "_v", (lo, hi), "feature").select("feature", F.get("q", F.lit(0)).alias("p16"), F.get("q", F.lit(1)).alias("p84"))
    poor = F.col("p16").isNull() | is_close(F.col("p16"), F.col("p84"))
    return found.select("feature", F.when(poor, "uninformative").otherwise("scale").alias("kind"), F.when(~poor, F.col("p16")).alias("p16"), F.when(~poor, F.col("p84")).alias("p84"))


def scale(x: Column, p16: Column, p84: Column) -> Column:
    return (x - p16) / (p84 - p16 + d(EPSILON)) * d(2.0) - d(1.0)


def scale_values(values: DataFrame, scalers: DataFrame) -> DataFrame:
    """values with `scaled`: affine where the scaler informs, else the value itself."""
    joined = values.join(small(scalers), "feature", "left")
    return joined.withColumn("scaled", F.when(F.col("kind") == "scale", scale(F.col("value"), F.col("p16"), F.col("p84"))).otherwise(F.col("value"))).drop("kind", "p16", "p84")


#: A table has at most so many features.
MAX_FEATURES = 10_000


def small(table: DataFrame) -> DataFrame:
    """A table of one row per feature, to be broadcast; its size is checked first."""
    rows = table.limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def scaler_table(scalers: DataFrame) -> dict[str, tuple[str, float | None, float | None]]:
    """The scalers on the driver: one entry per feature."""
    return {r.feature: (r.kind, r.p16, r.p84) for r in small(scalers).collect()}


def apply_scalers(arrays: dict[str, Column], scalers: dict[str, tuple[str, float | None, float | None]]) -> dict[str, Column]:
    """Arrays scaled by a driver-side table: names that start with pdg or fj_, uninformative ones and unknown ones pass."""

    def one(name: str, c: Column) -> Column:
        kind, lo, hi = scalers.get(name, ("none", None, None))
        if name.startswith(("pdg", "fj_")) or kind != "scale":
            return c
        return F.transform(c, lambda v: scale(v, d(lo), d(hi)))

    return {n: one(n, c) for n, c in arrays.items()}


def scaled_zero(scalers: DataFrame) -> DataFrame:
    """(feature, scaled_zero): the image of 0; NaN for passed pdg features, 0 for uninformative ones."""
    z = F.when(F.col("feature").startswith("pdg"), d(NAN)).when(F.col("kind") == "scale", scale(d(0.0), F.col("p16"), F.col("p84"))).otherwise(d(0.0))
    return scalers.select("feature", z.alias("scaled_zero"))


def standardize(nodes: DataFrame, features: list[str], train: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation of each feature, both from train only; a zero or missing deviation counts as 1."""
    stats = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features))
    out = nodes.crossJoin(F.broadcast(stats))  # one row
    for f in features:
        s = F.when(F.coalesce(F.col(f"s_{f}"), d(0.0)) == 0, d(1.0)).otherwise(F.col(f"s_{f}"))
        out = out.withColumn(f, (F.col(f) - F.col(f"m_{f}")) / s)
    return out.select(*nodes.columns)


def exclude_zeros(values: DataFrame, zeros: DataFrame, rel: float = 1e-4) -> DataFrame:
    """Values that are no NaN and not close to their feature's image of zero."""
    v, z = F.col("value"), F.col("scaled_zero")
    joined = values.join(small(zeros), "feature", "left")
    near = F.abs(v - z) <= d(rel) * F.greatest(F.abs(v), F.abs(z))
    return joined.where(~F.isnan(v) & (F.abs(v) <= d(INF)) & ~F.coalesce(near, F.lit(False))).drop("scaled_zero")
