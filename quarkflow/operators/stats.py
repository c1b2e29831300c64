"""Aggregates: descriptions, correlations, histograms, losses and running bests."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarkflow.functions.expr import INF, d
from quarkflow.operators.cells import with_cell


def not_nan(x: Column) -> Column:
    """NULL for NaN, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


#: Keys of exact_quantiles() at most (their bands are on the driver), values of a band that one task ranks, and the
#: accuracy of approximate quantiles: their rank is wrong by a share of 1 / _ACCURACY at most.
MAX_KEYS, MAX_BAND, _ACCURACY, _GRID = 10_000, 4_000_000, 2000, 200


def exact_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, q: array) of the linear-interpolation quantiles of values that are neither NULL nor NaN, one row per key; q is NULL for keys without values.

    Approximate quantiles give a band of values around each wanted rank. While a band may hold more than MAX_BAND values it
    is narrowed by quantiles inside it; then the values below a band are counted, those inside counted by value, and the ranks
    picked: a scan for the first bands and one for the ranks, and no task that holds a key's values. Runs at once;
    what is returned is one row per key.
    """
    spark = df.sparkSession
    names = [f"_key{i}" for i in range(len(keys))]
    x = not_nan(F.col(column).cast("double")).alias("_x")
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), x)
    near = sorted({min(1.0, max(0.0, q + e)) for q in quantiles for e in (-2 / _ACCURACY, 2 / _ACCURACY)})
    first = rows.groupBy(*names).agg(F.count("_x").alias("n"), F.percentile_approx("_x", near, _ACCURACY).alias("a")).limit(MAX_KEYS + 1)
    kinds = [first.schema[n] for n in names]
    found = first.collect()
    if len(found) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    found = [r for r in found if names or r.n]

    # (key number, quantile number): the band, ends included, and an upper bound of its values. A key of few values is one band.
    bands: dict[tuple[int, int], tuple[float, float, float]] = {}
    ranks: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i, r in enumerate(found):
        for j, q in enumerate(quantiles if r.n else ()):
            place = q * (r.n - 1)
            ranks[i, j] = math.floor(place), math.ceil(place), place - math.floor(place)
            low, high = (near.index(min(1.0, max(0.0, q + e))) for e in (-2 / _ACCURACY, 2 / _ACCURACY))
            whole = r.n <= 4 * _ACCURACY
            bands[i, j] = (-INF, INF, r.n) if whole else (r.a[low] if near[low] > 0 else -INF, r.a[high] if near[high] < 1 else INF, 8 * r.n / _ACCURACY)

    def beside(chosen: list[tuple[int, int]]) -> DataFrame:
        """(_i, _j, _lo, _hi, _x) of the rows at and below the top of each chosen band."""
        table = [(*(found[i][n] for n in names), i, j, *bands[i, j][:2]) for i, j in chosen]
        schema = T.StructType([*kinds, *(T.StructField(n, t()) for n, t in (("_i", T.IntegerType), ("_j", T.IntegerType), ("_lo", T.DoubleType), ("_hi", T.DoubleType)))])
        by_key = spark.createDataFrame(table, schema).groupBy(*names).agg(F.collect_list(F.struct("_i", "_j", "_lo", "_hi")).alias("_bands"))
        if names:
            met = rows.alias("r").join(F.broadcast(by_key.alias("b")), reduce(and_, (F.col(f"r.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names)))  # its size is checked
        else:
            met = rows.crossJoin(F.broadcast(by_key))  # one row
        return met.where("_x is not null").select("_x", F.inline("_bands")).where("_x <= _hi")

    wide = lambda: [b for b, (lo, hi, n) in bands.items() if n > MAX_BAND and lo < hi]
    while chosen := wide():
        inside = F.when(F.col("_x") >= F.col("_lo"), F.col("_x"))
        grid = beside(chosen).groupBy("_i", "_j").agg(F.count_if(F.col("_x") < F.col("_lo")).alias("below"), F.count(inside).alias("n"), F.percentile_approx(inside, [g / _GRID for g in range(1, _GRID)], _ACCURACY).alias("a"))
        for r in grid.collect():
            lo, hi, _ = bands[r._i, r._j]
            a, b = ((rank - r.below) / r.n for rank in ranks[r._i, r._j][:2])
            low, high = math.floor((a - 2 / _ACCURACY) * _GRID), math.ceil((b + 2 / _ACCURACY) * _GRID)
            new = r.a[low - 1] if low >= 1 else lo, r.a[high - 1] if high < _GRID else hi
            # A band that stays as it is holds few different values; they are counted by value.
            bands[r._i, r._j] = (*new, 0.0 if new == (lo, hi) else (high - low + 2) * r.n / _GRID)

    counts = beside(list(bands)).groupBy("_i", "_j", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_i", "_j").orderBy(F.col("_v").asc_nulls_first()))
    ranked = counts.withColumn("_upto", upto).join(F.broadcast(spark.createDataFrame([(i, j, *r[:2]) for (i, j), r in ranks.items()], "_i int, _j int, _first long, _last long")), ["_i", "_j"])
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col("_v")))
    picked = {(r._i, r._j): (r.a, r.b) for r in ranked.groupBy("_i", "_j").agg(at("_first").alias("a"), at("_last").alias("b")).collect()} if bands else {}
    out = []
    for i, r in enumerate(found):
        values = None
        if r.n:
            values = []
            for j in range(len(quantiles)):
                (a, b), part = picked[i, j], ranks[i, j][2]
                if a is None or b is None:
                    raise RuntimeError("a wanted rank lies outside its band")
                values.append(a * (1 - part) + b * part if part else a)
        out.append((*(r[n] for n in names), values))
    schema = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(keys, kinds)), T.StructField("q", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(out, schema)


def describe(df: DataFrame, column: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), *keys: str) -> DataFrame:
    """count, mean, sample std, min, quantiles (linear) and max, by keys."""
    x = not_nan(F.col(column).cast("double"))
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    found = exact_quantiles(df.withColumn("_v", x), "_v", quantiles, *keys)
    rows = plain.alias("a").join(found.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or F.lit(True), "left")
    named = [F.get("q", F.lit(i)).alias(f"p{q * 100:g}".replace(".", "_")) for i, q in enumerate(quantiles)]
    return rows.select(*(F.col(f"a.{k}") for k in keys), "n", "mean", "std", "min", *named, "max")


def jet_summary(particles: DataFrame, key: str = "jet_id") -> DataFrame:
    """Mean and population std of pt, stds of eta and phi, mean significances per jet."""
    return particles.groupBy(key).agg(
        F.avg("pt").alias("pt_mean"), F.stddev_pop("pt").alias("pt_std"), F.stddev_pop("eta").alias("eta_std"), F.stddev_pop("phi").alias("phi_std"),
        F.avg(not_nan(F.col("d0_sig"))).alias("d0_mean"), F.avg(not_nan(F.col("dz_sig"))).alias("dz_mean"),
    )


def correlations(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, a, b, r): Pearson correlation of every pair a <= b, rows with a NaN or NULL in either left out; all pairs in one aggregate."""
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    named = list(combinations_with_replacement(columns, 2))
    wide = df.groupBy(*keys).agg(*(F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(named)))
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(named)))))


def correlation_difference(r: DataFrame, key: str, first: object, second: object) -> DataFrame:
    """(a, b, dr): r of first minus r of second."""
    pick = lambda v: F.max(F.when(F.col(key) == v, F.col("r")))
    return r.groupBy("a", "b").agg((pick(first) - pick(second)).alias("dr"))


def histogram(df: DataFrame, column: str, bins: int, *keys: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(keys, bin, n, density): equal bins over [lo, hi] (the data's range without them), the last one closed. Empty bins have no row."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < d(INF))).select(*keys, x.alias("_x"))
    if lo is None or hi is None:
        span = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        rows = rows.crossJoin(F.broadcast(span))  # one row
    else:
        rows = rows.withColumn("_lo", d(lo)).withColumn("_hi", d(hi))
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).cast("int")
    counted = rows.where("_x >= _lo and _x <= _hi").groupBy(*keys, "_lo", "_hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(F.col(k) for k in keys))) if keys else F.sum("n").over(Window.partitionBy("_lo", "_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return counted.withColumn("density", F.try_divide(F.col("n"), total * width)).select(*keys, "bin", "n", "density")


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """(n_items, n_keys): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_items")).groupBy("n_items").agg(F.count(F.lit(1)).alias("n_keys"))


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str, name: str = "mean") -> DataFrame:
    """(keys, mean): sum(value * weight) / sum(weight), of rows where neither is NULL or NaN; NULL where weights sum to 0. What batch means of batches of unequal size make a mean of all."""
    v, w = (not_nan(F.col(c).cast("double")) for c in (value, weight))
    both = v.isNotNull() & w.isNotNull()
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w))).alias(name))


def masked_mse(rows: DataFrame, key: str, target: str, output: str, mask: str) -> DataFrame:
    """(key, loss): mean squared error of the masked rows of each key, its number taken as 1 at least."""
    square = (F.col(target) - F.col(output)) * (F.col(target) - F.col(output))
    return rows.groupBy(key).agg((F.sum(F.when(F.col(mask), square).otherwise(d(0.0))) / F.greatest(F.count_if(F.col(mask)), F.lit(1))).alias("loss"))


def index_loss(rows: DataFrame, pairs: list[tuple[str, str]], valid: str, *keys: str) -> DataFrame:
    """(keys, loss): squared error of slot i against token i, averaged over a token's (target, output) pairs and the valid tokens.

    By keys a key without a valid token has loss 0; without keys, no valid token gives NULL.
    """
    token = sum(((F.col(t) - F.col(o)) * (F.col(t) - F.col(o)) for t, o in pairs), d(0.0)) / d(len(pairs))
    n = F.count_if(F.col(valid))
    total = F.sum(F.when(F.col(valid), token).otherwise(d(0.0)))
    return rows.groupBy(*keys).agg((total / F.greatest(n, F.lit(1)) if keys else F.try_divide(total, n)).alias("loss"))


def cross_entropy(df: DataFrame, label: str, score: str, tiny: float = 1e-12) -> DataFrame:
    p = F.greatest(d(tiny), F.least(d(1 - tiny), F.col(score)))
    return df.agg((-F.avg(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))).alias("bce"))


def running_best(df: DataFrame, value: str, order: str, *keys: str, smallest: bool = True) -> DataFrame:
    """df with `best` (the best value so far) and `improved` (whether this row set it), by keys in the order of a column that tells a key's rows apart.

    Range cells of the order column carry the best of the cells before, so no task holds a key's rows.
    """
    f = F.min if smallest else F.max
    rows = with_cell(df, order)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per key and cell
    carried = rows.groupBy(*keys, "_cell").agg(f(value).alias("_b")).select(*keys, "_cell", f("_b").over(before).alias("_carried"))
    w = Window.partitionBy(*keys, "_cell").orderBy(order)
    inside = rows.withColumn("_before", f(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = inside.alias("a").join(carried.alias("b"), reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "_cell"))))
    best = F.least if smallest else F.greatest
    out = out.withColumn("_before", best("_before", "_carried"))
    better = F.col("_before").isNull() | ((F.col(value) < F.col("_before")) if smallest else (F.col(value) > F.col("_before")))
    return out.select(*(F.col(f"a.{c}") for c in df.columns), best("_before", f"a.{value}").alias("best"), better.alias("improved"))
