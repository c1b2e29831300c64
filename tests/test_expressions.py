"""Micro cases with expected values worked out by hand or NumPy."""

import math

import pytest
from pyspark.sql import functions as F

from quarkflow.functions import expr


def column(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_delta_phi(spark):
    got = column(spark, [(3.0, -3.0), (-3.0, 3.0), (math.pi, 0.0), (0.5, 0.2)], "a double, b double", expr.delta_phi(F.col("a"), F.col("b")))
    assert got == pytest.approx([-0.283185307, 0.283185307, -math.pi, 0.3])


def test_significance(spark):
    rows = list(zip([0.2, -0.3, 1.0, 0.0, -1.0, 0.4], [0.1, 0.1, 0.0, 0.0, -0.5, 0.1], [211, -11, 13, -13, 211, 22]))
    got = column(spark, rows, "v double, e double, p int", expr.significance(F.col("v"), F.col("e"), F.col("p")))
    assert got[:3] == pytest.approx([2, -3, 5]) and math.isnan(got[3]) and got[4:] == [0, 0]


def test_logarithm(spark):
    got = column(spark, [(1.0,), (0.0,), (-1.0,), (None,)], "x double", expr.log_or_inf(F.col("x")))
    assert got[0] == 0 and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None


def test_finite_and_close(spark):
    assert column(spark, [(1.0,), (math.inf,), (math.nan,), (None,)], "x double", expr.is_finite(F.col("x"))) == [True, False, False, False]
    assert column(spark, [(1.0, 1.0 + 1e-6), (1.0, 1.1)], "a double, b double", expr.is_close(F.col("a"), F.col("b"))) == [True, False]
    assert column(spark, [(math.nan,), (2.0,)], "x double", expr.zero_unless_finite(F.col("x"))) == [0.0, 2.0]


def test_file_names(spark):
    rows = [("/a/b/run.1.pkl",), ("plain",), (None,)]
    assert column(spark, rows, "p string", expr.stem(F.col("p"))) == ["run.1", "plain", ""]
    assert column(spark, rows, "p string", expr.extension(F.col("p"))) == [".pkl", "", ""]
