"""Event, jet and particle views over the star schema, as DataFrames and as the same views in DuckDB SQL.

orders are jets (event: o_custkey), lineitems their particles, events leptons, suppliers truth jets. Every number comes
from integer arithmetic or single IEEE operations, so both engines agree to the bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.functions.expr import d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, jet_id, fj_pt, fj_eta, fj_phi, fj_msoftdrop, label, gen_idx, gen_eta, gen_phi)."""
    k = F.col("o_orderkey")
    off = (k % 7) / d(10.0)
    eta, phi = (k % 451) / d(100.0) - d(2.25), ((k * 7919) % 6283) / d(1000.0) - d(3.1415)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event"), k.alias("jet_id"), (F.col("o_totalprice") / d(1000.0)).alias("fj_pt"), eta.alias("fj_eta"), phi.alias("fj_phi"),
        ((k % 97) / d(10.0)).alias("fj_msoftdrop"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (k % 120 - 10).alias("gen_idx"), (eta + off).alias("gen_eta"), (phi + off).alias("gen_phi"),
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, eta, phi) of truth jets."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("idx"), ((k * 37 % 451) / d(100.0) - d(2.25)).alias("eta"), (((k * 7919) % 6283) / d(1000.0) - d(3.1415)).alias("phi"))


def leptons(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(event, pt, eta, phi) of electrons (click) or muons (view)."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where(F.col("event_type") == {"electron": "click", "muon": "view"}[kind]).select(
        F.col("user_id").alias("event"), F.col("value").alias("pt"), ((k % 451) / d(100.0) - d(2.25)).alias("eta"), (((k * 7919) % 6283) / d(1000.0) - d(3.1415)).alias("phi")
    )


#: (return flag, line status) to a particle id.
IDS = {("A", "F"): -211, ("A", "O"): 211, ("N", "F"): 22, ("N", "O"): 130, ("R", "F"): 11, ("R", "O"): -13}


#: Particles that a task should hold: sorts, windows and joins by jet keep a task's rows in memory.
PER_TASK = 200_000


def by_jet(spark: SparkSession, rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows dealt out by jet into as many tasks as n particles ask for, so that a task's share doesn't grow with the table."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, math.ceil(n / PER_TASK)), key)


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(jet_id, idx, pt, eta, phi, mass, d0, d0_err, dz, dz_err, puppi, pdg_id, fj_pt, fj_msoftdrop, label)."""
    line = table(spark, sf_dir, "lineitem")
    n = line.count()  # of the files' footers
    line = by_jet(spark, line, "l_orderkey", n)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pdg = F.coalesce(*(F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), v) for (a, b), v in IDS.items()))
    jet = by_jet(spark, jets(spark, sf_dir).select("jet_id", "fj_pt", "fj_msoftdrop", "label"), "jet_id", n)
    rows = line.select(
        F.col("l_orderkey").alias("jet_id"), (F.row_number().over(order) - 1).alias("idx"), (F.col("l_extendedprice") / d(1000.0)).alias("raw_pt"),
        ((F.col("l_discount") - d(0.05)) * d(16.0)).alias("eta"), ((F.col("l_tax") - d(0.04)) * d(20.0)).alias("phi"), (F.col("l_quantity") / d(100.0)).alias("mass"),
        (F.col("l_quantity") - d(25.5)).alias("d0"), F.col("l_discount").alias("d0_err"), (F.col("l_quantity") - d(10.0)).alias("dz"), (F.col("l_tax") - d(0.01)).alias("dz_err"),
        F.when(F.col("l_linenumber") <= 5, d(1.0)).otherwise(d(0.5)).alias("puppi"), pdg.alias("pdg_id"),
    )
    out = rows.join(jet, "jet_id").withColumn("pt", F.col("raw_pt") / F.col("fj_pt"))
    return out.select("jet_id", "idx", "pt", "eta", "phi", "mass", "d0", "d0_err", "dz", "dz_err", "puppi", "pdg_id", "fj_pt", "fj_msoftdrop", "label")


def nested(particles_: DataFrame, *fields: str) -> DataFrame:
    """One row per jet with its particles as an array of structs (idx and these fields, all without any) in order of idx: the preprocessed table."""
    fields = ("idx", *(fields or ("pt", "eta", "phi", "mass", "d0", "d0_err", "dz", "dz_err", "puppi", "pdg_id")))
    return particles_.groupBy("jet_id", "fj_pt", "fj_msoftdrop", "label").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: arrays of jets (in order of jet_id), electrons and muons."""
    js = jets(spark, sf_dir).groupBy("event").agg(F.array_sort(F.collect_list(F.struct("jet_id", F.col("fj_pt").alias("pt"), F.col("fj_eta").alias("eta"), F.col("fj_phi").alias("phi")))).alias("jets"))
    for kind in ("electron", "muon"):
        js = js.join(leptons(spark, sf_dir, kind).groupBy("event").agg(F.collect_list(F.struct("pt", "eta", "phi")).alias(f"{kind}s")), "event", "left")
    return js


JETS_SQL = """jets AS (SELECT o_custkey AS event, o_orderkey AS jet_id, o_totalprice / 1e3 AS fj_pt, (o_orderkey % 451) / 1e2 - 225e-2 AS fj_eta,
  ((o_orderkey * 7919) % 6283) / 1e3 - 31415e-4 AS fj_phi, (o_orderkey % 97) / 1e1 AS fj_msoftdrop, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  o_orderkey % 120 - 10 AS gen_idx, ((o_orderkey % 451) / 1e2 - 225e-2) + (o_orderkey % 7) / 1e1 AS gen_eta,
  (((o_orderkey * 7919) % 6283) / 1e3 - 31415e-4) + (o_orderkey % 7) / 1e1 AS gen_phi FROM orders)"""
TRUTHS_SQL = "truths AS (SELECT s_suppkey AS idx, (s_suppkey * 37 % 451) / 1e2 - 225e-2 AS eta, ((s_suppkey * 7919) % 6283) / 1e3 - 31415e-4 AS phi FROM supplier)"
LEPTONS_SQL = """leps AS (SELECT user_id AS event, event_type AS kind, value AS pt, (event_id % 451) / 1e2 - 225e-2 AS eta, ((event_id * 7919) % 6283) / 1e3 - 31415e-4 AS phi
  FROM events WHERE event_type IN ('click', 'view'))"""
_CASES = " ".join(f"WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' THEN {v}" for (a, b), v in IDS.items())
PARTICLES_SQL = f"""parts AS (SELECT l_orderkey AS jet_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS idx,
  (l_extendedprice / 1e3) / fj_pt AS pt, (l_discount - 5e-2) * 16e0 AS eta, (l_tax - 4e-2) * 20e0 AS phi, l_quantity / 1e2 AS mass, l_quantity - 255e-1 AS d0, l_discount AS d0_err,
  l_quantity - 10e0 AS dz, l_tax - 1e-2 AS dz_err, CASE WHEN l_linenumber <= 5 THEN 1e0 ELSE 5e-1 END AS puppi, CASE {_CASES} END AS pdg_id, fj_pt, fj_msoftdrop, label
  FROM lineitem JOIN jets ON jet_id = l_orderkey)"""


def _sig(v: str, e: str) -> str:
    ratio = f"CASE WHEN {e} = 0 THEN (CASE WHEN {v} > 0 THEN 5e0 WHEN {v} < 0 THEN -5e0 ELSE 'nan'::DOUBLE END) ELSE greatest(-5e0, least(5e0, {v} / {e})) END"
    return f"CASE WHEN pdg_id IN (11, -11, 13, -13, 211, -211) AND {e} >= 0 THEN {ratio} ELSE 0e0 END"


FEATURES_SQL = f"""feats AS (SELECT *, {_sig('d0', 'd0_err')} AS d0_sig, {_sig('dz', 'dz_err')} AS dz_sig, sqrt(eta * eta + phi * phi) AS dr,
  CASE WHEN pt > 0 THEN ln(pt) WHEN pt = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS log_pt FROM parts)"""
WITH_JETS, WITH_LEPTONS = f"WITH {JETS_SQL}", f"WITH {JETS_SQL}, {LEPTONS_SQL}"
WITH_PARTS, WITH_FEATURES = f"WITH {JETS_SQL}, {PARTICLES_SQL}", f"WITH {JETS_SQL}, {PARTICLES_SQL}, {FEATURES_SQL}"
PI_SQL, TWO_PI_SQL = "3.141592653589793e0", "6.283185307179586e0"


def dphi_sql(a: str, b: str) -> str:
    x = f"(({a}) - ({b}) + {PI_SQL})"
    return f"({x} - {TWO_PI_SQL} * floor({x} / {TWO_PI_SQL}) - {PI_SQL})"


def dr_sql(e1: str, p1: str, e2: str, p2: str) -> str:
    return f"sqrt((({e1}) - ({e2})) * (({e1}) - ({e2})) + {dphi_sql(p1, p2)} * {dphi_sql(p1, p2)})"
