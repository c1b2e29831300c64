"""The batch path from event tables to scaled jet tables, and its small tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import delta_phi
from quarkflow.operators import features, scaling, select, splits
from quarkflow.sources import readers

#: Jet properties that are carried along where an event table has them. Fixed values.
JET_PROPERTIES = (
    "phi", "eta", "pt", "mass", "msoftdrop", "particleNetWithMass_QCD", "particleNet_XbbVsQCD", "particleNet_XccVsQCD", "particleNet_XqqVsQCD", "particleNet_QCD", "particleNet_massCorr",
)


def _objects(events: DataFrame, prefix: str, names: dict[str, str]) -> Column:
    """Aligned arrays prefix_* as an array of structs under the given names; absent ones are an error, a NULL array is empty."""
    missing = [n for n in names if f"{prefix}_{n}" not in events.columns]
    if missing:
        raise ValueError(f"{prefix} lacks {', '.join(missing)}")
    zipped = F.arrays_zip(*(F.col(f"{prefix}_{n}").alias(a) for n, a in names.items()))
    none = F.filter(F.array(F.struct(*(F.lit(0.0).alias(a) for a in names.values()))), lambda x: F.lit(False))
    return F.coalesce(zipped, none)


def preprocess(events: DataFrame, lo: float = select.PT_MIN, hi: float = select.PT_MAX, id_col: str = "event_id") -> DataFrame:
    """One row per event whose leading passing jet has constituents: their arrays (pt, eta, phi relative to the jet, all other PFCands fields) and the jet's properties as fj_*."""
    columns = [p for p in JET_PROPERTIES if f"FatJet_{p}" in events.columns]
    zipped = F.arrays_zip(*(F.col(f"FatJet_{p}").alias(p) for p in columns), F.col("FatJet_genJetAK8Idx").alias("gen_idx"))
    jets = F.transform(zipped, lambda j, i: j.withField("index", i))
    flat = {"pt": "pt", "eta": "eta", "phi": "phi"}
    passing = select.passing_jets(jets, _objects(events, "Electron", flat), _objects(events, "Muon", flat), _objects(events, "GenJetAK8", {"eta": "eta", "phi": "phi"}), lo, hi)
    best = events.withColumn("_best", select.leading(passing)).where("_best is not null")
    bridge = F.arrays_zip(F.col("FatJetPFCands_jetIdx").alias("jet"), F.col("FatJetPFCands_pFCandsIdx").alias("particle"))
    at = F.transform(F.filter(bridge, lambda b: b["jet"] == F.col("_best.index")), lambda b: b["particle"])
    best = best.withColumn("_at", at).where("size(_at) > 0")
    own = {c.removeprefix("PFCands_"): c for c in readers.branches(events, "PFCands_")}
    gathered = {n: features.gather(F.col(c), F.col("_at")) for n, c in own.items()}
    relative = {
        "pt": F.transform(gathered["pt"], lambda x: F.try_divide(x, F.col("_best.pt"))),
        "eta": F.transform(gathered["eta"], lambda x: x - F.col("_best.eta")),
        "phi": F.transform(gathered["phi"], lambda x: delta_phi(x, F.col("_best.phi"))),
    }
    rest = [gathered[n].alias(n) for n in own if n not in relative]
    return best.select(F.col(id_col).alias("jet_id"), *(c.alias(n) for n, c in relative.items()), *(F.col(f"_best.{p}").alias(f"fj_{p}") for p in columns), *rest)


def add_features(table: DataFrame, codes: list[int] | tuple[int, ...] = (), mask_muons: bool = False) -> DataFrame:
    """A preprocessed table with `parts` (structs of all its arrays, the derived features and a 0/1 field pdg_* per code, in bounds only) and within_bounds (original positions).

    Rows with a missing value are dropped; arrays not as long as pt are an error. mask_muons: parts without the muons of low pt.
    """
    arrays = [n for n, t in table.dtypes if t.startswith("array")]
    table = features.checked_rows(table.na.drop("any"), "pt", arrays)
    named = {"d0Err": "d0_err", "dzErr": "dz_err", "pdgId": "pdg_id", "puppiWeight": "puppi"}
    zipped = features.with_features(F.arrays_zip(*(F.col(a).alias(named.get(a, a)) for a in arrays)))
    hot = features.one_hot(zipped["pdg_id"], list(codes))
    if hot:
        zipped = F.transform(zipped, lambda p: reduce(lambda q, v: q.withField(v[0], (p["pdg_id"] == v[1]).cast("int")), zip(hot, codes), p))
    scalars = [c for c in table.columns if c not in arrays]
    rows = table.select(*scalars, zipped.alias("parts"))
    parts = features.bounded(F.col("parts"))
    return rows.withColumn("within_bounds", features.within_bounds(F.col("parts"))).withColumn("parts", select.low_pt_muons(parts) if mask_muons else parts)


def _featured(background: DataFrame, signal: DataFrame, names: tuple[str, ...], lo: float | None, hi: float | None, mask_muons: bool) -> tuple[list[DataFrame], list[str], DataFrame]:
    """(both tables with parts, names of the one-hots, the background's scalers). Codes are those of both tables."""
    cut = [select.pt_slice(t, lo=lo, hi=hi) if (lo is not None or hi is not None) else t for t in (background, signal)]
    codes = features.vocabulary(cut[0].select("pdgId").unionByName(cut[1].select("pdgId")), "pdgId") if "pdgId" in background.columns else []
    both = [add_features(cut[0], codes), add_features(cut[1], codes, mask_muons)]
    return both, list(features.one_hot(F.array(), codes)), scaling.percentile_scalers(scaling.long_values(both[0], {n: F.col(f"parts.{n}") for n in names}))


def _scaled(table: DataFrame, names: tuple[str, ...], hot: list[str], scalers: DataFrame) -> DataFrame:
    by_name = scaling.apply_scalers({n: F.col(f"parts.{n}") for n in names}, scaling.scaler_table(scalers))
    return table.select(*(c for c in table.columns if c != "parts"), *(c.alias(n) for n, c in by_name.items()), *(F.col(f"parts.{h}").alias(h) for h in hot if h not in names))


def process(background: DataFrame, signal: DataFrame, names: tuple[str, ...], lo: float | None = None, hi: float | None = None, mask_muons: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scaled background, scaled signal, scalers): features and one-hots added, the inclusive jet window applied, named arrays scaled by the background's percentiles. mask_muons: of the signal."""
    both, hot, scalers = _featured(background, signal, names, lo, hi, mask_muons)
    return _scaled(both[0], names, hot, scalers), _scaled(both[1], names, hot, scalers), scalers


def process_outputs(background: DataFrame, signal: DataFrame, names: tuple[str, ...], lo: float | None = None, hi: float | None = None, mask_muons: bool = False, labels: tuple[str, str] = ("background", "signal")) -> dict[str, DataFrame]:
    """Every table of a processing run by its place: the scaled jets, and below other/ each class's raw and scaled values (feature, value) and the scaled place of 0 (feature, scaled_zero), besides the scalers."""
    both, hot, scalers = _featured(background, signal, names, lo, hi, mask_muons)
    out = {"scalers": scalers}
    for table, label in zip(both, labels):
        raw = scaling.long_values(table, {n: F.col(f"parts.{n}") for n in names})
        out[f"{label}_scaled"] = _scaled(table, names, hot, scalers)
        out[f"other/{label}_rawvals"] = raw.select("feature", "value")
        out[f"other/{label}_scaledvals"] = scaling.scale_values(raw, scalers).select("feature", F.col("scaled").alias("value"))
        out[f"other/{label}_zero"] = scaling.scaled_zero(scalers)  # the background's scalers scale both
    return out


def concat(tables: list[DataFrame], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Tables of one column list, cut to a strict jet window; a bound of 0 or None is none."""
    df = splits.union_strict(tables)
    return select.pt_slice(df, lo=lo or None, hi=hi or None, inclusive=False) if (lo or hi) else df


def info(df: DataFrame) -> dict:
    """Rows, columns and types."""
    return {"rows": df.count(), "columns": len(df.columns), "types": dict(df.dtypes)}
