"""Range cells of a column: what a total order over a whole table is made of without a task that holds it.

Borders come from a row sample, so cells hold like numbers of rows, and there are as many as the row count asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that a cell should hold, rows drawn for each, and cells at most.
PER_CELL, DRAW, MAX_CELLS = 500_000, 50, 4096


def _key(df: DataFrame, column: Column) -> Column:
    """The column as a number or a text of the same order."""
    kind = df.select(column.alias("k")).schema["k"].dataType
    if isinstance(kind, T.TimestampType | T.DateType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.IntegralType | T.StringType):
        return column.cast("long") if isinstance(kind, T.IntegralType) else column
    return column.cast("double")


def with_cell(df: DataFrame, column: Column | str, name: str = "_cell", per_cell: int = PER_CELL) -> DataFrame:
    """df with the number of the range cell of column: a smaller value never has a larger one. NULL has -1, NaN comes last; equal values share a cell.

    The driver sees DRAW values per cell.
    """
    spark = df.sparkSession
    key = _key(df, F.col(column) if isinstance(column, str) else column)
    n = df.count()
    cells = min(MAX_CELLS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // per_cell))
    drawn = [r.k for r in df.sample(min(1.0, DRAW * cells / max(n, 1)), seed=11).select(key.alias("k")).collect()]
    drawn = sorted(v for v in drawn if v is not None and not (isinstance(v, float) and math.isnan(v)))
    borders = sorted(set(drawn[DRAW::DRAW]))
    if not borders:
        return df.withColumn(name, F.when(key.isNull(), -1).otherwise(0))
    text = isinstance(borders[0], str)
    table = np.array(borders, object) if text else np.array(borders)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, values.to_numpy(table.dtype), "right").astype(np.int32))

    # NULL is kept from the function: it would turn whole numbers into floating-point ones.
    filled = F.coalesce(key, F.lit("") if text else F.lit(0).cast("double" if table.dtype.kind == "f" else "long"))
    return df.withColumn(name, F.when(key.isNull(), -1).otherwise(place(filled)))


def before_cells(sums: DataFrame, names: dict[str, str], *keys: str, cell: str = "_cell", descending: bool = False) -> DataFrame:
    """sums (keys, cell, sums) with the totals of the cells before under the names given: at most MAX_CELLS + 1 rows per key."""
    order = F.desc(cell) if descending else F.col(cell)
    over = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    over = over.rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, cell, *(F.coalesce(F.sum(a).over(over), F.lit(0)).alias(b) for a, b in names.items()))
