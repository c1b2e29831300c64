"""Splits, samples, unions, reshapes and sweeps. Order is always by a column, never the row order of files.

Ranks over a whole table are made per range partition: a window without keys would put all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.operators.cells import before_cells, with_cell


def numbered(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """df with rn (from 1) in the total order of the order columns.

    Rows are cut into range cells of the first column; a row's rank is the sum of the cells before its own plus its rank
    inside it. Rows that share the first column's value share a cell.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = with_cell(df, order[0])
    base = before_cells(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), {"_n": "_before"})
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return rows.withColumn("_i", inside).join(F.broadcast(base), "_cell").withColumn(name, F.col("_i") + F.col("_before")).drop("_cell", "_i", "_before")


def with_total(df: DataFrame, name: str = "total", where: Column | None = None) -> DataFrame:
    counted = df.agg((F.count(F.lit(1)) if where is None else F.count_if(where)).alias(name))
    return df.crossJoin(F.broadcast(counted))  # one row


def ordered_split(df: DataFrame, order: str, fraction: float = 0.8) -> DataFrame:
    """df with split: `train` for the first int(fraction * n) rows, `test` for the rest."""
    rows = with_total(numbered(df, order))
    return rows.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("total") * fraction), "train").otherwise("test")).drop("rn", "total")


def test_size(n: Column, fraction: float) -> Column:
    """max(1, half-even round of n * fraction)."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction)), 0).cast("long"))


def three_way_split(df: DataFrame, order: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """df with split: train, then val, then test in the order given; fewer than 3 rows are an error."""
    few = F.raise_error(F.lit("a three-way split needs 3 rows"))
    rows = with_total(numbered(df, order))
    n = F.col("total")
    n_test, n_val = test_size(n, test), test_size(n, val)
    too_many = n - n_test - n_val < 1
    n_test, n_val = F.when(too_many, 1).otherwise(n_test), F.when(too_many, 1).otherwise(n_val)
    split = F.when(n < 3, few).when(F.col("rn") <= n - n_val - n_test, "train").when(F.col("rn") <= n - n_test, "val").otherwise("test")
    return rows.withColumn("split", split).drop("rn", "total")


def three_way_borders(df: DataFrame, order: str, val: float = 0.1, test: float = 0.1) -> tuple[int | float | str, int | float | str] | None:
    """The last values of order in three_way_split's train and val, so that a comparison splits the table; None if no value parts them (fewer than 3 rows, NULLs, equal values on both sides of a border).

    Only the order column is read: rows are counted by range cell, and the two cells that hold a border are sorted.
    """
    rows = df.select(order)
    n, missing = rows.agg(F.count(F.lit(1)), F.count_if(F.col(order).isNull())).first()
    if n < 3 or missing:
        return None
    n_test, n_val = rows.sparkSession.range(1).select(test_size(F.lit(n), test), test_size(F.lit(n), val)).first()
    if n - n_test - n_val < 1:
        n_test = n_val = 1
    cells = with_cell(rows, order)
    sizes = sorted((r["_cell"], r["count"]) for r in cells.groupBy("_cell").count().collect())  # MAX_CELLS at most
    found = []
    for rank in (n - n_val - n_test, n - n_test):
        before = 0
        for cell, size in sizes:
            if before + size >= rank:
                break
            before += size
        pair = [r[0] for r in cells.where(F.col("_cell") == cell).select(order).orderBy(order).offset(rank - before - 1).limit(1).collect()]
        found.append(pair[0])
    upto = rows.agg(*(F.count_if(F.col(order) <= F.lit(v)) for v in found)).first()
    return tuple(found) if list(upto) == [n - n_val - n_test, n - n_test] else None


def test_first_split(df: DataFrame, order: str, fraction: float = 0.2, max_train: int | None = None, max_test: int | None = None) -> DataFrame:
    """df with split: the first clamp(round(fraction * n), 1, n - 1) rows are test, the rest train; caps drop later rows of either."""
    rows = with_total(numbered(df, order))
    n_test = F.greatest(F.lit(1), F.least(F.bround(F.col("total") * F.lit(float(fraction)), 0).cast("long"), F.col("total") - 1))
    rows = rows.withColumn("split", F.when(F.col("rn") <= n_test, "test").otherwise("train")).withColumn("_nth", F.when(F.col("rn") <= n_test, F.col("rn")).otherwise(F.col("rn") - n_test))
    for name, cap in (("test", max_test), ("train", max_train)):
        if cap is not None:
            rows = rows.where((F.col("split") != name) | (F.col("_nth") <= cap))
    return rows.drop("rn", "total", "_nth")


def balanced(df: DataFrame, label: str, *order: Column | str) -> DataFrame:
    """The first rows of either class (0/1), as many as the smaller one has."""
    sizes = df.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_m"))
    parts = [numbered(df.where(F.col(label) == y), *order) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).crossJoin(F.broadcast(sizes)).where("rn <= _m").drop("rn", "_m")


def combined(background: DataFrame, signal: DataFrame, label: str, *ids: str, balance: bool = True, seed: int = 42) -> DataFrame:
    """Rows of both classes in a random order that the seed fixes (position, from 1), by the md5 of `seed:ids`; balance: the larger class is first cut, in that order, to the smaller one's rows."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))
    rows = labelled_union(background, signal, label).withColumn("_mixed", mixed)
    rows = balanced(rows, label, "_mixed", *ids) if balance else rows
    return numbered(rows, "_mixed", *ids, name="position").drop("_mixed")


def shuffled(*columns: str, seed: int = 42) -> Column:
    """A column whose order is a fixed random permutation."""
    return F.xxhash64(*columns, F.lit(seed))


def sample(df: DataFrame, n: int, *columns: str, seed: int = 42) -> DataFrame:
    """n rows at random, the same for a seed."""
    return df.orderBy(shuffled(*columns, seed=seed), *columns).limit(n)


def head(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by order, all without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def union_strict(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of tables whose column lists must be the same, order included."""
    first = tables[0].columns
    for i, t in enumerate(tables[1:], 1):
        if t.columns != first:
            raise ValueError(f"columns of table {i} differ: {sorted(set(t.columns) ^ set(first)) or 'order'}")
    return reduce(DataFrame.union, tables)


def union_loose(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def labelled_union(background: DataFrame, signal: DataFrame, label: str = "label") -> DataFrame:
    return background.withColumn(label, F.lit(0)).unionByName(signal.withColumn(label, F.lit(1)))


def token_mask(idx: str, size: str, ratio: float, *keys: str, seed: int = 0) -> Column:
    """Whether a token is masked: half-even round(size * ratio) tokens of each key, by the md5 of `seed:keys:position`."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, idx)), idx)
    return F.row_number().over(w) <= F.bround(F.col(size) * F.lit(float(ratio)), 0)


def pivot_unique(df: DataFrame, rows: str, columns: str, value: str, names: Sequence | None = None) -> DataFrame:
    """rows x columns of value; a repeated cell is an error."""
    cells = df.groupBy(rows, columns).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn(value, F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated cell"))).otherwise(F.col(value)))
    return cells.groupBy(rows).pivot(columns, list(names) if names is not None else None).agg(F.first(value))


def sweep_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """The product of the axes' values, run_idx from 0 in their order: a grid of parameters, written on the driver."""
    rows = [(i, *p) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["run_idx", *axes])


def top_runs(df: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    """The n rows of largest value, NaN and NULL last."""
    return df.orderBy(F.desc_nulls_last(F.when(~F.isnan(value), F.col(value))), *ties).limit(n)
