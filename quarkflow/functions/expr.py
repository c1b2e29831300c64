"""Column expressions: angles, ratios, logarithms and kinematics with the conventions of floating-point array code.

NaN and infinities are values and stay apart from NULL; nothing raises on a zero divisor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi
#: Particle ids of charged tracks, whose impact parameters mean something. Fixed values.
TRACK_IDS = (11, -11, 13, -13, 211, -211)
NAN, INF = float("nan"), float("inf")


def d(x: float) -> Column:
    return F.lit(float(x))


def delta_phi(a: Column, b: Column) -> Column:
    """a - b wrapped into [-pi, pi)."""
    x = a - b + d(PI)
    return x - d(TWO_PI) * F.floor(x / d(TWO_PI)) - d(PI)


def delta_r(eta_a: Column, phi_a: Column, eta_b: Column, phi_b: Column) -> Column:
    x, y = eta_a - eta_b, delta_phi(phi_a, phi_b)
    return F.sqrt(x * x + y * y)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < d(INF))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|."""
    return F.abs(a - b) <= d(atol) + d(rtol) * F.abs(b)


def log_or_inf(x: Column) -> Column:
    """ln x; -inf at 0, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, d(-INF)).when(x.isNotNull(), d(NAN))


def log10_or_inf(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, d(-INF)).when(x.isNotNull(), d(NAN))


def significance(value: Column, error: Column, pdg_id: Column, clip: float = 5.0) -> Column:
    """value / error clipped to +-clip; 0 for a negative error or a particle that is no track; 0/0 is NaN."""
    ratio = F.when(error == 0, F.when(value > 0, d(clip)).when(value < 0, d(-clip)).otherwise(d(NAN))).otherwise(F.greatest(d(-clip), F.least(d(clip), F.try_divide(value, error))))
    ratio = F.when(F.isnan(value), d(NAN)).otherwise(ratio)
    return F.when(pdg_id.isin(*TRACK_IDS) & (error >= 0) & ~F.isnan(error), ratio).otherwise(d(0.0))


def zero_unless_finite(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(d(0.0))


def momentum(pt: Column, eta: Column, phi: Column, mass: Column) -> dict[str, Column]:
    """px, py, pz and energy."""
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return {"px": px, "py": py, "pz": pz, "e": F.sqrt(px * px + py * py + pz * pz + mass * mass)}


def pair_mass(e: Column, px: Column, py: Column, pz: Column, floor: bool) -> Column:
    """Mass of a summed four-momentum; a negative square is cut at 0 (floor) or taken absolute."""
    square = e * e - (px * px + py * py + pz * pz)
    return F.sqrt(F.greatest(square, d(0.0)) if floor else F.abs(square))


def sigmoid(x: Column) -> Column:
    return d(1.0) / (d(1.0) + F.exp(-x))


def stem(path: Column) -> Column:
    """File name without folder and last extension; '' for null."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit(""))


def extension(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"(\.[^./]*)$", 1), F.lit(""))


def safe_name(feature: str) -> str:
    """A feature's name as part of a file name."""
    return feature.replace("/", "_")
