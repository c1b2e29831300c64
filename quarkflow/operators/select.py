"""Selection: windows, vetoes, truth matching and the leading object, on nested arrays or on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import INF, d, delta_phi, delta_r

#: Cuts of the selection. Fixed values.
JET_ETA_MAX, LEPTON_PT_MIN, LEPTON_DR_MIN, GEN_DR_MAX, PT_MIN, PT_MAX = 2.0, 20.0, 0.4, 0.4, 200.0, 1e10


def inside(x: Column, lo: float | None = None, hi: float | None = None, inclusive: bool = False) -> Column:
    """x within (lo, hi), or [lo, hi] if inclusive; a missing bound is none."""
    out = F.lit(True)
    if lo is not None:
        out = out & ((x >= d(lo)) if inclusive else (x > d(lo)))
    if hi is not None:
        out = out & ((x <= d(hi)) if inclusive else (x < d(hi)))
    return out


def pt_slice(df: DataFrame, column: str = "fj_pt", lo: float | None = None, hi: float | None = None, inclusive: bool = True) -> DataFrame:
    """Rows whose column lies within the bounds; an absent column is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.where(inside(F.col(column), lo, hi, inclusive))


def good_leptons(leptons: Column, pt_min: float = LEPTON_PT_MIN) -> Column:
    return F.filter(leptons, lambda x: x["pt"] > d(pt_min))


def isolated(eta: Column, phi: Column, leptons: Column, dr_min: float = LEPTON_DR_MIN) -> Column:
    """Whether no object of the array lies within dr_min; true for an empty or null array."""
    return ~F.coalesce(F.exists(leptons, lambda x: delta_r(eta, phi, x["eta"], x["phi"]) <= d(dr_min)), F.lit(False))


def least_delta_r(eta: Column, phi: Column, objects: Column) -> Column:
    """Distance to the nearest object of the array, +inf without any."""
    return F.coalesce(F.array_min(F.transform(objects, lambda x: delta_r(eta, phi, x["eta"], x["phi"]))), d(INF))


def matched(eta: Column, phi: Column, index: Column, truths: Column, dr_max: float = GEN_DR_MAX) -> Column:
    """Whether the object that index names in the array (0-based; outside: none) lies closer than dr_max."""
    truth = F.get(truths, index)
    return F.coalesce((index >= 0) & (index < F.size(truths)) & (delta_r(eta, phi, truth["eta"], truth["phi"]) < d(dr_max)), F.lit(False))


def passing_jets(jets: Column, electrons: Column, muons: Column, truths: Column | None = None, lo: float = PT_MIN, hi: float = PT_MAX) -> Column:
    """Jets of an event that pass every cut, cheap cuts first."""
    electrons, muons = good_leptons(electrons), good_leptons(muons)

    def keep(j: Column) -> Column:
        out = inside(j["pt"], lo, hi) & (F.abs(j["eta"]) < d(JET_ETA_MAX)) & isolated(j["eta"], j["phi"], electrons) & isolated(j["eta"], j["phi"], muons)
        return out if truths is None else out & matched(j["eta"], j["phi"], j["gen_idx"], truths)

    return F.filter(jets, keep)


def leading(jets: Column) -> Column:
    """The array's element of largest pt, the first of equals; NULL of an empty array."""
    best = F.array_max(F.transform(jets, lambda j: j["pt"]))
    return F.get(F.filter(jets, lambda j: j["pt"] == best), F.lit(0))


def veto_rows(jets: DataFrame, leptons: DataFrame, event: str, dr_min: float = LEPTON_DR_MIN, pt_min: float = LEPTON_PT_MIN) -> DataFrame:
    """jets (fj_eta, fj_phi) without a lepton (pt, eta, phi) of the same event within dr_min: an anti join on the event and the distance."""
    near = leptons.where(F.col("pt") > d(pt_min)).select(F.col(event).alias("_event"), F.col("eta").alias("_eta"), F.col("phi").alias("_phi"))
    return jets.join(near, (jets[event] == near["_event"]) & (delta_r(jets["fj_eta"], jets["fj_phi"], near["_eta"], near["_phi"]) <= d(dr_min)), "left_anti")


def match_rows(jets: DataFrame, truths: DataFrame, dr_max: float = GEN_DR_MAX) -> DataFrame:
    """jets whose gen_idx names a row of truths (idx, eta, phi) that lies closer than dr_max, with the truth's direction as gen_eta and gen_phi."""
    named = truths.select(F.col("idx").alias("gen_idx"), F.col("eta").alias("gen_eta"), F.col("phi").alias("gen_phi"))
    found = jets.drop("gen_eta", "gen_phi").join(named, "gen_idx")
    return found.where(delta_r(F.col("fj_eta"), F.col("fj_phi"), F.col("gen_eta"), F.col("gen_phi")) < d(dr_max))


def constituents(jets: DataFrame, particles: DataFrame, key: str = "jet_id") -> DataFrame:
    """One row per particle of a selected jet; jets without particles drop out."""
    return jets.join(particles, key)


def relative(pt: Column, eta: Column, phi: Column, jet_pt: Column, jet_eta: Column, jet_phi: Column) -> dict[str, Column]:
    """A particle's pt, eta and phi relative to its jet."""
    return {"pt": F.try_divide(pt, jet_pt), "eta": eta - jet_eta, "phi": delta_phi(phi, jet_phi)}


def low_pt_muons(particles: Column, muon: int = 13, pt_min: float = 0.4) -> Column:
    """Array without the muons below pt_min."""
    return F.filter(particles, lambda p: (F.abs(p["pdg_id"]) != muon) | (p["pt"] >= d(pt_min)))
