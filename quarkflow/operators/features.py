"""Per-particle features over arrays of structs: one transform per row, inside code generation, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import d, log_or_inf, significance

#: Particles of a jet lie within this distance and carry this weight. Fixed values.
RADIUS, WEIGHT = 0.8, 1.0


def with_features(particles: Column) -> Column:
    """The array's structs with d0_sig, dz_sig, dr and log_pt."""
    return F.transform(
        particles,
        lambda p: p.withField("d0_sig", significance(p["d0"], p["d0_err"], p["pdg_id"]))
        .withField("dz_sig", significance(p["dz"], p["dz_err"], p["pdg_id"]))
        .withField("dr", F.sqrt(p["eta"] * p["eta"] + p["phi"] * p["phi"]))
        .withField("log_pt", log_or_inf(p["pt"])),
    )


def in_bounds(p: Column, radius: float = RADIUS, weight: float = WEIGHT) -> Column:
    return (F.abs(p["dr"]) <= d(radius)) & (p["puppi"] == d(weight))


def within_bounds(particles: Column) -> Column:
    """Positions (0-based, rising) of the particles in bounds."""
    at = F.transform(particles, lambda p, i: F.when(in_bounds(p), i))
    return F.filter(at, lambda i: i.isNotNull())


def bounded(particles: Column) -> Column:
    """The particles in bounds."""
    return F.filter(particles, lambda p: in_bounds(p))


def gather(values: Column, positions: Column) -> Column:
    """Elements at 0-based positions; NULL where there is none."""
    return F.transform(positions, lambda i: F.get(values, i))


def vocabulary(df: DataFrame, array: str) -> list[int]:
    """Sorted distinct values of an array column: a code list of at most MAX_CODES, gathered from partial sets."""
    rows = df.select(F.explode(array).alias("v")).where("v is not null").distinct().limit(MAX_CODES + 1).collect()
    if len(rows) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    return sorted(r[0] for r in rows)


MAX_CODES = 1000


def one_hot(values: Column, codes: list[int], prefix: str = "pdg_") -> dict[str, Column]:
    """One 0/1 array per code."""

    def hot(v: int) -> Column:
        return F.transform(values, lambda x: (x == v).cast("int"))

    return {f"{prefix}{str(v).replace('-', 'm')}": hot(v) for v in codes}


def valid_rows(df: DataFrame, length_of: str, features: list[str]) -> DataFrame:
    """Rows whose feature arrays are as long as length_of; absent columns are an error."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    ok = F.lit(True)
    for c in features:
        ok = ok & (F.size(c) == F.size(length_of))
    return df.where(ok)


def checked_rows(df: DataFrame, length_of: str, features: list[str]) -> DataFrame:
    """df, or an error when a row is read whose feature arrays are not as long as length_of: every row is checked, in the scan that uses it. Absent columns are an error at once."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    bad = [F.when(F.size(c).eqNullSafe(F.size(length_of)), F.lit(True)).otherwise(F.raise_error(F.lit(f"{c} is not as long as {length_of}")).cast("boolean")) for c in features]
    return df.where(F.lit(True) if not bad else reduce(and_, bad))


def feature_list(text: str) -> list[str]:
    """Names of a comma list, trimmed; an empty list is an error."""
    out = [x.strip() for x in text.split(",") if x.strip()]
    if not out:
        raise ValueError("no feature named")
    return out


def stacked(arrays: list[str]) -> Column:
    """array<array<float>>: row i holds element i of every array; shorter arrays give NULLs, or an error of node_stack."""
    return F.transform(F.arrays_zip(*arrays), lambda z: F.array(*(z[a].cast("float") for a in arrays)))


def node_stack(df: DataFrame, arrays: list[str], name: str = "x") -> DataFrame:
    """df with the arrays stacked; an absent column or arrays of several lengths are an error."""
    return checked_rows(df, arrays[0], arrays).withColumn(name, stacked(arrays))


def within_capacity(values: Column, size: int) -> Column:
    """True, as a condition on rows; an array of more than size elements is an error. For use before padded, which cuts such arrays."""
    return F.when(F.size(values) > size, F.raise_error(F.concat(F.size(values).cast("string"), F.lit(f" elements for {size} slots"))).cast("boolean")).isNull()


def padded(values: Column, size: int, fill: float = 0.0) -> tuple[Column, Column]:
    """(array of exactly size elements, 0/1 mask of the true ones); longer arrays are cut, or an error of within_capacity."""
    n = F.least(F.size(values), F.lit(size))
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))
