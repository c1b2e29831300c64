"""Registered queries of the array and event operators, each with the DuckDB SQL of the same result.

Sums of floating-point numbers are rounded to 6 digits in both, as their order differs; selections are compared unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.functions.expr import d, log10_or_inf, sigmoid
from quarkflow.operators import features, graphs, metrics, scaling, select, splits, stats
from quarkflow.plans import fixtures as fx
from quarkflow.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

FEATURES = ("pt", "eta", "phi", "d0_sig", "dz_sig", "dr", "log_pt")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested table with features."""
    return fx.nested(fx.particles(spark, sf_dir)).withColumn("parts", features.with_features(F.col("parts")))


def flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("jet_id", *keep, F.inline("parts"))


_PASS = f"fj_pt > 200 AND fj_pt < 400 AND abs(fj_eta) < 2e0"
_VETO = f"NOT EXISTS (SELECT 1 FROM leps l WHERE l.event = jets.event AND l.pt > 20 AND {fx.dr_sql('jets.fj_eta', 'jets.fj_phi', 'l.eta', 'l.phi')} <= 4e-1)"
_LEAD = f"lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY fj_pt DESC, jet_id) AS r FROM jets WHERE {_PASS} AND {_VETO}) WHERE r = 1)"


# --- selection ----------------------------------------------------------------------------------------------------


@register(f"{fx.WITH_LEPTONS}, {_LEAD} SELECT event, jet_id, fj_pt AS pt, fj_eta AS eta, fj_phi AS phi FROM lead")
def lead_jet_select(spark, sf_dir):
    """The whole cascade on nested events: window, eta, both vetoes, leading jet; events without one drop out."""
    ev = fx.events(spark, sf_dir)
    best = select.leading(select.passing_jets(F.col("jets"), F.col("electrons"), F.col("muons"), lo=200, hi=400))
    return ev.select("event", best.alias("j")).where("j is not null").select("event", "j.*")


@register(f"{fx.WITH_LEPTONS} SELECT event, jet_id, fj_pt FROM jets WHERE {_VETO}")
def lepton_veto(spark, sf_dir):
    leps = fx.leptons(spark, sf_dir, "electron").unionByName(fx.leptons(spark, sf_dir, "muon"))
    return select.veto_rows(fx.jets(spark, sf_dir), leps, "event").select("event", "jet_id", "fj_pt")


@register(f"{fx.WITH_LEPTONS} SELECT event, round(min({fx.dr_sql('jets.fj_eta', 'jets.fj_phi', 'l.eta', 'l.phi')}), 6) AS dr FROM jets JOIN leps l USING (event) WHERE kind = 'view' GROUP BY event")
def nearest_muon(spark, sf_dir):
    ev = fx.events(spark, sf_dir).where("muons is not null")
    near = F.array_min(F.transform("jets", lambda j: select.least_delta_r(j["eta"], j["phi"], F.col("muons"))))
    return ev.select("event", F.round(near, 6).alias("dr"))


@register(f"{fx.WITH_JETS}, {fx.TRUTHS_SQL} SELECT event, jet_id, gen_idx, round(t.eta, 6) AS gen_eta FROM jets JOIN truths t ON t.idx = gen_idx WHERE {fx.dr_sql('fj_eta', 'fj_phi', 't.eta', 't.phi')} < 4e-1")
def gen_match(spark, sf_dir):
    found = select.match_rows(fx.jets(spark, sf_dir), fx.truths(spark, sf_dir))
    return rounded(found.select("event", "jet_id", "gen_idx", "gen_eta"), "gen_eta")


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt FROM jets WHERE fj_pt >= 200 AND fj_pt <= 400")
def pt_window_inclusive(spark, sf_dir):
    return select.pt_slice(fx.jets(spark, sf_dir), lo=200, hi=400).select("jet_id", "fj_pt")


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt FROM jets WHERE fj_pt > 200 AND fj_pt < 400")
def pt_window_strict(spark, sf_dir):
    return select.pt_slice(fx.jets(spark, sf_dir), lo=200, hi=400, inclusive=False).select("jet_id", "fj_pt")


@register(f"{fx.WITH_LEPTONS}, {fx.PARTICLES_SQL}, {_LEAD} SELECT lead.event, jet_id, idx, pt, pdg_id FROM lead JOIN parts USING (jet_id)")
def constituents(spark, sf_dir):
    lead = lead_jet_select(spark, sf_dir).select("event", "jet_id")
    return select.constituents(lead, fx.particles(spark, sf_dir)).select("event", "jet_id", "idx", "pt", "pdg_id")


@register(f"{fx.WITH_PARTS} SELECT jet_id, idx, round(pt / fj_pt, 6) + 0e0 AS rel_pt, round(eta - fj_eta, 6) + 0e0 AS rel_eta, round({fx.dphi_sql('phi', 'fj_phi')}, 6) + 0e0 AS rel_phi FROM parts JOIN (SELECT jet_id, fj_eta, fj_phi FROM jets) USING (jet_id)")
def rel_features(spark, sf_dir):
    rows = fx.particles(spark, sf_dir).join(fx.jets(spark, sf_dir).select("jet_id", "fj_eta", "fj_phi"), "jet_id")
    rel = select.relative(F.col("pt"), F.col("eta"), F.col("phi"), F.col("fj_pt"), F.col("fj_eta"), F.col("fj_phi"))
    return rows.select("jet_id", "idx", *((F.round(c, 6) + d(0.0)).alias(f"rel_{n}") for n, c in rel.items()))


@register(f"{fx.WITH_PARTS} SELECT jet_id, idx, pt FROM parts WHERE abs(pdg_id) <> 13 OR pt >= 4e-1")
def low_pt_muon_mask(spark, sf_dir):
    df = fx.nested(fx.particles(spark, sf_dir)).withColumn("parts", select.low_pt_muons(F.col("parts")))
    return flat(df).select("jet_id", "idx", "pt")


# --- features -----------------------------------------------------------------------------------------------------


@register(f"{fx.WITH_FEATURES} SELECT jet_id, idx, CASE WHEN isnan(d0_sig) THEN NULL ELSE round(d0_sig, 6) END AS d0_sig, CASE WHEN isnan(dz_sig) THEN NULL ELSE round(dz_sig, 6) END AS dz_sig FROM feats")
def ip_significance(spark, sf_dir):
    rows = flat(featured(spark, sf_dir))
    return rows.select("jet_id", "idx", *(F.round(stats.not_nan(F.col(c)), 6).alias(c) for c in ("d0_sig", "dz_sig")))


@register(f"{fx.WITH_FEATURES} SELECT jet_id, idx, round(dr, 6) AS dr FROM feats WHERE abs(dr) <= 8e-1 AND puppi = 1")
def in_bounds_filter(spark, sf_dir):
    df = featured(spark, sf_dir).withColumn("parts", features.bounded(F.col("parts")))
    return flat(df).select("jet_id", "idx", F.round("dr", 6).alias("dr"))


@register(f"{fx.WITH_FEATURES} SELECT jet_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS positions FROM feats WHERE abs(dr) <= 8e-1 AND puppi = 1 GROUP BY jet_id")
def within_bounds(spark, sf_dir):
    df = featured(spark, sf_dir).select("jet_id", features.within_bounds(F.col("parts")).alias("at")).where("size(at) > 0")
    return df.select("jet_id", F.array_join(F.col("at").cast("array<string>"), ",").alias("positions"))


@register(f"{fx.WITH_FEATURES} SELECT jet_id, idx, round(log_pt, 6) AS log_pt FROM feats")
def log_pt(spark, sf_dir):
    return flat(featured(spark, sf_dir)).select("jet_id", "idx", F.round("log_pt", 6).alias("log_pt"))


_CODES = sorted(fx.IDS.values())


@register(f"{fx.WITH_PARTS} SELECT jet_id, {', '.join(f'''CAST(sum(CASE WHEN pdg_id = {v} THEN 1 ELSE 0 END) AS BIGINT) AS n_{str(v).replace('-', 'm')}''' for v in _CODES)} FROM parts GROUP BY jet_id")
def pdg_onehot(spark, sf_dir):
    df = fx.nested(fx.particles(spark, sf_dir)).withColumn("ids", F.transform("parts", lambda p: p["pdg_id"]))
    hot = features.one_hot(F.col("ids"), features.vocabulary(df, "ids"), prefix="n_")
    return df.select("jet_id", *(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias(n) for n, c in hot.items()))


_HOT_SQL = ", ".join(f"CAST(pdg_id = {v} AS INTEGER) AS pdg_{str(v).replace('-', 'm')}" for v in _CODES)


@register(f"{fx.WITH_PARTS} SELECT jet_id, idx, {_HOT_SQL} FROM parts")
def pdg_onehot_rows(spark, sf_dir):
    """Every element of the one-hot arrays."""
    df = fx.nested(fx.particles(spark, sf_dir)).withColumn("ids", F.transform("parts", lambda p: p["pdg_id"]))
    hot = features.one_hot(F.col("ids"), features.vocabulary(df, "ids"))
    rows = df.select("jet_id", F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in hot.items()))).alias("idx", "h"))
    return rows.select("jet_id", "idx", *(F.col(f"h.{n}").alias(n) for n in hot))


@register(f"{fx.WITH_PARTS} SELECT DISTINCT pdg_id FROM parts")
def distinct_ids(spark, sf_dir):
    return fx.particles(spark, sf_dir).select("pdg_id").distinct()


# --- scaling ------------------------------------------------------------------------------------------------------


def _values(spark, sf_dir, label: int | None = 0) -> DataFrame:
    df = featured(spark, sf_dir)
    df = df if label is None else df.where(F.col("label") == label)
    return scaling.long_values(df, {n: F.col(f"parts.{n}") for n in FEATURES}, "label")


def _features(spark, sf_dir) -> DataFrame:
    """(label, arrays of the scaled features) of every jet: all that percentiles and scaled values need, to be written once."""
    return featured(spark, sf_dir).select("label", *(F.col(f"parts.{n}").alias(n) for n in FEATURES))


_LONG = " UNION ALL ".join(f"SELECT label, '{n}' AS feature, {n} AS value FROM feats" for n in FEATURES)
_SCALERS = f"""vals AS ({_LONG}), sc AS (SELECT feature, quantile_cont(value, 16e-2) AS a, quantile_cont(value, 84e-2) AS b FROM vals
  WHERE label = 0 AND value <> 0 AND NOT isnan(value) AND NOT isinf(value) GROUP BY feature)"""


@register(f"{fx.WITH_FEATURES}, {_SCALERS} SELECT feature, 'scale' AS kind, round(a, 6) AS p16, round(b, 6) AS p84 FROM sc")
def scaler_p16_p84(spark, sf_dir):
    return rounded(scaling.percentile_scalers(_values(spark, sf_dir)), "p16", "p84")


@register(f"{fx.WITH_FEATURES}, {_SCALERS} SELECT label, feature, count(*) AS n, round(avg((value - a) / (b - a + 1e-6) * 2 - 1), 6) AS mean FROM vals JOIN sc USING (feature) WHERE NOT isnan(value) GROUP BY label, feature")
def scaled_features(spark, sf_dir):
    values = scaling.long_values(written(_features(spark, sf_dir), "features"), {n: F.col(n) for n in FEATURES}, "label")
    scalers = scaling.percentile_scalers(values.where("label = 0"))
    rows = scaling.scale_values(values, scalers).where("not isnan(value)")
    return rounded(rows.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("scaled").alias("mean")), "mean")


@register(f"{fx.WITH_FEATURES}, {_SCALERS} SELECT feature, round((0 - a) / (b - a + 1e-6) * 2 - 1, 6) + 0e0 AS scaled_zero FROM sc")
def scaled_zero(spark, sf_dir):
    return rounded(scaling.scaled_zero(scaling.percentile_scalers(_values(spark, sf_dir))), "scaled_zero").withColumn("scaled_zero", F.col("scaled_zero") + d(0.0))


_BOUNDED = "bounded AS (SELECT * FROM feats WHERE abs(dr) <= 8e-1 AND puppi = 1)"


@register(f"""{fx.WITH_LEPTONS}, {fx.PARTICLES_SQL}, {fx.FEATURES_SQL}, {_LEAD}, b AS (SELECT f.* FROM feats f JOIN lead USING (jet_id) WHERE abs(dr) <= 8e-1 AND puppi = 1),
  s AS (SELECT quantile_cont(log_pt, 16e-2) AS a, quantile_cont(log_pt, 84e-2) AS z FROM b WHERE label = 0 AND log_pt <> 0 AND NOT isinf(log_pt) AND NOT isnan(log_pt))
  SELECT jet_id, count(*) AS n, round(avg((log_pt - a) / (z - a + 1e-6) * 2 - 1), 6) AS mean_scaled FROM b, s GROUP BY jet_id""")
def flagship(spark, sf_dir):
    """Leading jets, their in-bounds particles, background percentiles, scaled summary per jet."""
    lead = lead_jet_select(spark, sf_dir).select("jet_id")
    particles = fx.particles(spark, sf_dir).join(lead, "jet_id", "left_semi")  # leading jets alone are nested
    df = fx.nested(particles).withColumn("parts", features.bounded(features.with_features(F.col("parts"))))
    rows = written(flat(df, "label").select("jet_id", "label", F.col("log_pt").alias("value")), "bounded").withColumn("feature", F.lit("log_pt"))
    scaled = scaling.scale_values(rows, scaling.percentile_scalers(rows.where("label = 0")))
    return rounded(scaled.groupBy("jet_id").agg(F.count(F.lit(1)).alias("n"), F.avg("scaled").alias("mean_scaled")), "mean_scaled")


@register(f"""{fx.WITH_PARTS}, s AS (SELECT avg(pt) AS m, stddev_samp(pt) AS s FROM parts WHERE label = 0) SELECT label, count(*) AS n, round(avg((pt - m) / s), 6) + 0e0 AS mean, round(stddev_pop((pt - m) / s), 6) AS std FROM parts, s GROUP BY label""")
def standardize(spark, sf_dir):
    rows = fx.particles(spark, sf_dir).select("label", "pt")
    out = scaling.standardize(rows, ["pt"], rows.where("label = 0"))
    return rounded(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("pt").alias("mean"), F.stddev_pop("pt").alias("std")), "mean", "std").withColumn("mean", F.col("mean") + d(0.0))


@register(f"{fx.WITH_PARTS} SELECT jet_id, idx, pt FROM parts WHERE label = 1")
def explode_values(spark, sf_dir):
    return flat(fx.nested(fx.particles(spark, sf_dir)).where("label = 1")).select("jet_id", "idx", "pt")


# --- graphs -------------------------------------------------------------------------------------------------------

_K = 3
_PAIR = "a JOIN parts b ON a.jet_id = b.jet_id"


def _edges_sql(distance: str, loops: bool, k: int, rows: str = "parts") -> str:
    return f"""SELECT jet_id, center, neighbor, rank FROM (SELECT jet_id, center, neighbor, CAST(row_number() OVER (PARTITION BY jet_id, center ORDER BY round(d, 12), neighbor) AS INTEGER) AS rank
      FROM (SELECT a.jet_id, a.idx AS center, b.idx AS neighbor, {distance} AS d FROM {rows} a JOIN {rows} b ON a.jet_id = b.jet_id {'' if loops else 'AND a.idx <> b.idx'})) WHERE rank <= {k}"""


def _nodes(spark, sf_dir) -> DataFrame:
    return fx.particles(spark, sf_dir)


_EDGE = ("jet_id", "center", "neighbor", "rank")
_D2 = "sqrt((a.eta - b.eta) * (a.eta - b.eta) + (a.phi - b.phi) * (a.phi - b.phi))"


@register(f"{fx.WITH_PARTS} {_edges_sql(_D2, False, _K)}")
def knn_eta_phi(spark, sf_dir):
    return graphs.build(_nodes(spark, sf_dir), "eta_phi", _K).select(*_EDGE)


@register(f"{fx.WITH_PARTS} {_edges_sql('sqrt(0e0 + (a.pt - b.pt) * (a.pt - b.pt) + (a.eta - b.eta) * (a.eta - b.eta) + (a.phi - b.phi) * (a.phi - b.phi) + (a.mass - b.mass) * (a.mass - b.mass))', False, _K)}")
def knn_all_features(spark, sf_dir):
    return graphs.build(_nodes(spark, sf_dir), "all_features", _K, ["pt", "eta", "phi", "mass"]).select(*_EDGE)


@register(f"{fx.WITH_PARTS} SELECT a.jet_id, a.idx AS center, b.idx AS neighbor FROM parts {_PAIR} WHERE a.jet_id IN (SELECT jet_id FROM parts GROUP BY jet_id HAVING count(*) >= 2)")
def fully_connected(spark, sf_dir):
    return graphs.build(_nodes(spark, sf_dir), "fully_connected", _K).select("jet_id", "center", "neighbor")


_KIN = "kin AS (SELECT *, pt * cos(phi) AS px, pt * sin(phi) AS py, pt * sinh(eta) AS pz FROM parts), kine AS (SELECT *, sqrt(px * px + py * py + pz * pz + mass * mass) AS e FROM kin WHERE jet_id IN (SELECT jet_id FROM parts GROUP BY jet_id HAVING count(*) >= 2))"
_M2 = "((a.e + b.e) * (a.e + b.e) - ((a.px + b.px) * (a.px + b.px) + (a.py + b.py) * (a.py + b.py) + (a.pz + b.pz) * (a.pz + b.pz)))"


@register(f"{fx.WITH_PARTS}, {_KIN}, e AS ({_edges_sql(f'1e0 / (sqrt(abs({_M2})) + 1e-6)', True, _K + 1, 'kine')}) SELECT jet_id, center, count(*) AS n FROM e GROUP BY jet_id, center")
def mass_knn(spark, sf_dir):
    edges = graphs.build(_nodes(spark, sf_dir), "mass_knn", _K)
    return edges.groupBy("jet_id", "center").agg(F.count(F.lit(1)).alias("n"))


@register(f"""{fx.WITH_PARTS}, {_KIN}, p AS (SELECT a.jet_id, a.idx AS c, b.idx AS o, 1e0 / (sqrt(abs({_M2})) + 1e-6) AS d FROM kine a JOIN kine b ON a.jet_id = b.jet_id)
  SELECT jet_id, c AS center, round(min(d), 5) AS nearest FROM p GROUP BY jet_id, c""")
def mass_knn_nearest(spark, sf_dir):
    edges = graphs.build(_nodes(spark, sf_dir), "mass_knn", _K)
    return edges.groupBy("jet_id", "center").agg(F.round(F.min("d"), 5).alias("nearest"))


@register(f"""{fx.WITH_PARTS}, {_KIN}, w AS (SELECT a.jet_id, a.idx AS c, b.idx AS o, a.fj_msoftdrop AS m0, sqrt(greatest({_M2}, 0e0)) AS m,
    (a.eta - b.eta) AS x, CASE WHEN abs(a.phi - b.phi) > {fx.PI_SQL} THEN {fx.TWO_PI_SQL} - abs(a.phi - b.phi) ELSE abs(a.phi - b.phi) END AS y FROM kine a JOIN kine b ON a.jet_id = b.jet_id),
  v AS (SELECT *, sqrt(x * x + y * y) AS r FROM w), u AS (SELECT *, min(r) OVER (PARTITION BY jet_id) AS lo, max(r) OVER (PARTITION BY jet_id) AS hi FROM v)
  SELECT jet_id, c AS center, round(min(5e-1 * ((r - lo) / (hi - lo + 1e-6)) + 5e-1 * (1e0 / (m + 1e-6) * (m0 + 1e-6))), 4) AS nearest FROM u GROUP BY jet_id, c""")
def hybrid_knn(spark, sf_dir):
    edges = graphs.build(_nodes(spark, sf_dir), "hybrid_knn", _K, alpha=0.5)
    return edges.groupBy("jet_id", "center").agg(F.round(F.min("d"), 4).alias("nearest"))


@register(f"{fx.WITH_PARTS}, {_KIN} {_edges_sql(f'1e0 / (sqrt(abs({_M2})) + 1e-6)', True, _K + 1, 'kine')}")
def mass_knn_edges(spark, sf_dir):
    return graphs.build(_nodes(spark, sf_dir), "mass_knn", _K).select(*_EDGE)


@register(f"""{fx.WITH_PARTS}, {_KIN}, w AS (SELECT a.jet_id, a.idx AS center, b.idx AS neighbor, a.fj_msoftdrop AS m0, sqrt(greatest({_M2}, 0e0)) AS m,
    (a.eta - b.eta) AS x, CASE WHEN abs(a.phi - b.phi) > {fx.PI_SQL} THEN {fx.TWO_PI_SQL} - abs(a.phi - b.phi) ELSE abs(a.phi - b.phi) END AS y FROM kine a JOIN kine b ON a.jet_id = b.jet_id),
  v AS (SELECT *, sqrt(x * x + y * y) AS r FROM w), u AS (SELECT *, min(r) OVER (PARTITION BY jet_id) AS lo, max(r) OVER (PARTITION BY jet_id) AS hi FROM v),
  q AS (SELECT *, row_number() OVER (PARTITION BY jet_id, center ORDER BY round(5e-1 * ((r - lo) / (hi - lo + 1e-6)) + 5e-1 * (1e0 / (m + 1e-6) * (m0 + 1e-6)), 12), neighbor) AS rk FROM u)
  SELECT jet_id, center, neighbor, CAST(rk AS INTEGER) AS rank FROM q WHERE rk <= {_K + 1}""")
def hybrid_knn_edges(spark, sf_dir):
    return graphs.build(_nodes(spark, sf_dir), "hybrid_knn", _K, alpha=0.5).select(*_EDGE)


@register(f"{fx.WITH_PARTS}, e AS ({_edges_sql(_D2, False, _K)}) SELECT DISTINCT jet_id, least(center, neighbor) AS a, greatest(center, neighbor) AS b FROM e")
def undirected_edges(spark, sf_dir):
    return graphs.undirected(graphs.build(_nodes(spark, sf_dir), "eta_phi", _K))


_POOL = f"SELECT jet_id, idx, s, row_number() OVER (PARTITION BY jet_id ORDER BY s DESC, idx) AS r, count(*) OVER (PARTITION BY jet_id) AS n FROM (SELECT *, (0e0 + pt * 1e0 + eta * 5e-1) / sqrt(125e-2) AS s FROM parts)"


@register(f"{fx.WITH_PARTS} SELECT jet_id, idx, round(tanh(s), 6) AS score FROM ({_POOL}) WHERE r <= ceil(5e-1 * n)")
def top_k_nodes(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    kept, _ = graphs.top_k_pool(nodes, graphs.fully_connected(nodes), ["pt", "eta"], [1.0, 0.5])
    return rounded(kept.select("jet_id", "idx", "score"), "score")


@register(f"{fx.WITH_PARTS}, p AS ({_POOL}), k AS (SELECT * FROM p WHERE r <= ceil(5e-1 * n)), e AS ({_edges_sql(_D2, False, _K)}) SELECT e.* FROM e JOIN k a ON e.jet_id = a.jet_id AND e.center = a.idx JOIN k b ON e.jet_id = b.jet_id AND e.neighbor = b.idx")
def top_k_edges(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    _, edges = graphs.top_k_pool(nodes, graphs.build(nodes, "eta_phi", _K), ["pt", "eta"], [1.0, 0.5])
    return edges.select(*_EDGE)


@register(f"{fx.WITH_PARTS} SELECT jet_id, max(pt) AS max_pt, max(eta) AS max_eta FROM parts GROUP BY jet_id")
def global_pool(spark, sf_dir):
    return graphs.pooled(_nodes(spark, sf_dir), ["pt", "eta"])


@register(f"{fx.WITH_PARTS}, e AS ({_edges_sql(_D2, False, _K)}) SELECT e.jet_id, e.center, max(b.pt - a.pt) AS max_dx_pt FROM e JOIN parts a ON a.jet_id = e.jet_id AND a.idx = e.center JOIN parts b ON b.jet_id = e.jet_id AND b.idx = e.neighbor GROUP BY e.jet_id, e.center")
def edge_max(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return graphs.edge_max(graphs.eta_phi_messages(nodes, _K, ["pt"]), ["dx_pt"])


#: A rule for weights, so that both engines have the same ones.
_IN, _INNER, _OUT = ("pt", "eta", "phi", "mass"), 6, 3


def _weight(i: int, j: int) -> float:
    return ((7 * i + 3 * j + 1) % 11 - 5) / 8


_W1, _B1 = [[_weight(i, j) for j in range(_INNER)] for i in range(2 * len(_IN))], [_weight(j, 9) for j in range(_INNER)]
_W2, _B2 = [[_weight(i + 2, j) for j in range(_OUT)] for i in range(_INNER)], [_weight(j, 4) for j in range(_OUT)]


def _dense_sql(inputs: list[str], weights: list[list[float]], bias: list[float]) -> list[str]:
    return [" + ".join([*(f"({x}) * CAST({row[j]!r} AS DOUBLE)" for x, row in zip(inputs, weights)), f"CAST({bias[j]!r} AS DOUBLE)"]) for j in range(len(bias))]


_INNER_SQL = ", ".join(f"{x} AS i{j}" for j, x in enumerate(_dense_sql([f"a.{c}" for c in _IN] + [f"b.{c} - a.{c}" for c in _IN], _W1, _B1)))
_RELU_SQL = [f"CASE WHEN i{j} > 0 THEN i{j} ELSE i{j} * 1e-1 END" for j in range(_INNER)]


@register(f"""{fx.WITH_PARTS}, e AS ({_edges_sql(_D2, False, _K)}), i AS (SELECT e.jet_id, e.center, {_INNER_SQL} FROM e JOIN parts a ON a.jet_id = e.jet_id AND a.idx = e.center JOIN parts b ON b.jet_id = e.jet_id AND b.idx = e.neighbor)
  SELECT jet_id, center, {', '.join(f'round(max({x}), 6) AS h{j}' for j, x in enumerate(_dense_sql(_RELU_SQL, _W2, _B2)))} FROM i GROUP BY jet_id, center""")
def learned_edge_message(spark, sf_dir):
    """A learned edge convolution, two dense layers a message, without Python."""
    nodes = _nodes(spark, sf_dir)
    h = graphs.edge_layer(graphs.eta_phi_messages(nodes, _K, list(_IN)), list(_IN), (_W1, _B1), (_W2, _B2), slope=0.1)
    return h.select("jet_id", "center", *(F.round(F.get("h", F.lit(j)), 6).alias(f"h{j}") for j in range(_OUT)))


# --- statistics ---------------------------------------------------------------------------------------------------


@register(f"{fx.WITH_JETS} SELECT label, count(*) AS n, round(avg(fj_pt), 6) AS mean, round(stddev_samp(fj_pt), 6) AS std, min(fj_pt) AS min, round(quantile_cont(fj_pt, 25e-2), 6) AS p25, round(quantile_cont(fj_pt, 50e-2), 6) AS p50, round(quantile_cont(fj_pt, 75e-2), 6) AS p75, max(fj_pt) AS max FROM jets GROUP BY label")
def describe_pt(spark, sf_dir):
    return rounded(stats.describe(fx.jets(spark, sf_dir), "fj_pt", (0.25, 0.5, 0.75), "label"), "mean", "std", "p25", "p50", "p75")


@register(f"{fx.WITH_PARTS}, c AS (SELECT jet_id, CAST(count(*) AS DOUBLE) AS k FROM parts GROUP BY jet_id) SELECT count(*) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k) AS min, round(quantile_cont(k, 50e-2), 6) AS p50, round(quantile_cont(k, 90e-2), 6) AS p90, round(quantile_cont(k, 95e-2), 6) AS p95, round(quantile_cont(k, 99e-2), 6) AS p99, max(k) AS max FROM c")
def multiplicity(spark, sf_dir):
    df = written(fx.particles(spark, sf_dir).groupBy("jet_id", "fj_pt", "fj_msoftdrop", "label").agg(F.count(F.lit(1)).cast("int").alias("k")).select("k"), "sizes")
    return rounded(stats.describe(df, "k", (0.5, 0.9, 0.95, 0.99)), "mean", "std", "p50", "p90", "p95", "p99")


@register(f"{fx.WITH_JETS}, c AS (SELECT event, count(*) AS n_items FROM jets GROUP BY event) SELECT n_items, count(*) AS n_keys FROM c GROUP BY n_items")
def jets_per_event(spark, sf_dir):
    return stats.multiplicity(fx.jets(spark, sf_dir), "event")


@register(f"{fx.WITH_JETS}, c AS (SELECT event, count(*) AS k, sum(fj_pt) AS s, avg(fj_pt) AS m FROM jets GROUP BY event) SELECT k AS n_jets, round(sum(s), 2) AS sum_pt, round(avg(m), 6) AS mean_pt FROM c GROUP BY k")
def pt_by_multiplicity(spark, sf_dir):
    per = fx.jets(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n_jets"), F.sum("fj_pt").alias("s"), F.avg("fj_pt").alias("m"))
    return per.groupBy("n_jets").agg(F.round(F.sum("s"), 2).alias("sum_pt"), F.round(F.avg("m"), 6).alias("mean_pt"))


_SUMMARY = "summ AS (SELECT jet_id, label, avg(pt) AS pt_mean, stddev_pop(pt) AS pt_std, stddev_pop(eta) AS eta_std, stddev_pop(phi) AS phi_std, avg(d0_sig) FILTER (NOT isnan(d0_sig)) AS d0_mean, avg(dz_sig) FILTER (NOT isnan(dz_sig)) AS dz_mean FROM feats GROUP BY jet_id, label)"
_SUMMARY_COLUMNS = ("pt_mean", "pt_std", "eta_std", "phi_std", "d0_mean", "dz_mean")


@register(f"{fx.WITH_FEATURES}, {_SUMMARY} SELECT jet_id, {', '.join(f'round({c}, 6) AS {c}' for c in _SUMMARY_COLUMNS)} FROM summ")
def jet_summary(spark, sf_dir):
    return rounded(stats.jet_summary(flat(featured(spark, sf_dir))), *_SUMMARY_COLUMNS)


_CORR = " UNION ALL ".join(f"SELECT label, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM summ GROUP BY label" for i, a in enumerate(_SUMMARY_COLUMNS) for b in _SUMMARY_COLUMNS[i:])


def _correlations(spark, sf_dir) -> DataFrame:
    per = stats.jet_summary(flat(featured(spark, sf_dir), "label").withColumn("jet_id", F.struct("jet_id", "label"))).withColumn("label", F.col("jet_id.label"))
    return stats.correlations(per, list(_SUMMARY_COLUMNS), "label")


@register(f"{fx.WITH_FEATURES}, {_SUMMARY} SELECT label, a, b, round(r, 6) AS r FROM ({_CORR})")
def corr_matrix(spark, sf_dir):
    return rounded(_correlations(spark, sf_dir), "r")


@register(f"{fx.WITH_FEATURES}, {_SUMMARY}, c AS ({_CORR}) SELECT s.a, s.b, round(s.r - g.r, 6) + 0e0 AS dr FROM c s JOIN c g ON s.a = g.a AND s.b = g.b AND s.label = 1 AND g.label = 0")
def corr_diff(spark, sf_dir):
    return rounded(stats.correlation_difference(_correlations(spark, sf_dir), "label", 1, 0), "dr").withColumn("dr", F.col("dr") + d(0.0))


@register(f"{fx.WITH_JETS}, h AS (SELECT label, CAST(least(floor((fj_pt - 0e0) / (500e0 - 0e0) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM jets WHERE fj_pt BETWEEN 0 AND 500 GROUP BY 1, 2) SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * 10e0), 9) AS density FROM h")
def hist_density(spark, sf_dir):
    h = stats.histogram(fx.jets(spark, sf_dir), "fj_pt", 50, "label", lo=0, hi=500)
    return h.withColumn("density", F.round("density", 9))


@register(f"{fx.WITH_FEATURES}, v AS (SELECT d0_sig FROM feats WHERE NOT isnan(d0_sig) AND d0_sig <> 0) SELECT CAST(least(floor((d0_sig + 5e0) / 10e0 * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1")
def zero_excluded_hist(spark, sf_dir):
    rows = flat(featured(spark, sf_dir)).select(F.lit("d0_sig").alias("feature"), F.col("d0_sig").alias("value"))
    zeros = spark.range(1).select(F.lit("d0_sig").alias("feature"), d(0.0).alias("scaled_zero"))
    return stats.histogram(scaling.exclude_zeros(rows, zeros), "value", 100, lo=-5, hi=5).select("bin", "n")


@register(f"{fx.WITH_PARTS} SELECT count(*) AS n_rows, CAST(count(DISTINCT jet_id) AS BIGINT) AS n_jets FROM parts")
def table_shape(spark, sf_dir):
    return fx.particles(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("jet_id").alias("n_jets"))


@register(f"{fx.WITH_JETS} SELECT count(*) AS before, CAST(count(*) FILTER (fj_pt >= 200 AND fj_pt <= 400) AS BIGINT) AS kept FROM jets")
def filter_counts(spark, sf_dir):
    return fx.jets(spark, sf_dir).agg(F.count(F.lit(1)).alias("before"), F.count_if(select.inside(F.col("fj_pt"), 200, 400, True)).alias("kept"))


# --- metrics ------------------------------------------------------------------------------------------------------

_SCORES = "sc AS (SELECT fj_pt AS score, label FROM jets)"


def _scores(spark, sf_dir) -> DataFrame:
    return fx.jets(spark, sf_dir).select(F.col("fj_pt").alias("score"), "label")


@register(f"""{fx.WITH_JETS}, {_SCORES}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY score DESC))
  SELECT score AS threshold, round(fp / nn, 9) AS fpr, round(tp / np, 9) AS tpr FROM c""")
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(_scores(spark, sf_dir)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_AUC = """g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY score), c AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM g)
  SELECT round(sum(p * (below + n / 2e0)) / (sum(p) * CAST(sum(n) AS DOUBLE)), 9) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM c"""


@register(f"{fx.WITH_JETS}, {_SCORES}, {_AUC}")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scores(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@register(f"WITH sc AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), {_AUC}")
def quality_auc(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return metrics.roc_auc(rows).withColumn("auc", F.round("auc", 9))


@register(f"{fx.WITH_JETS} SELECT round(avg(CASE WHEN CAST(1 / (1 + exp(-(fj_pt - 250) / 5e1)) >= 5e-1 AS INTEGER) = label THEN 1e0 ELSE 0e0 END), 9) AS accuracy, count(*) AS n FROM jets")
def accuracy(spark, sf_dir):
    rows = fx.jets(spark, sf_dir).select(sigmoid((F.col("fj_pt") - 250) / d(50.0)).alias("score"), "label")
    return metrics.accuracy(rows).withColumn("accuracy", F.round("accuracy", 9))


@register(f"{fx.WITH_PARTS} SELECT jet_id, round(sum(CASE WHEN puppi = 1 THEN (eta - phi) * (eta - phi) ELSE 0e0 END) / greatest(count(*) FILTER (puppi = 1), 1), 6) AS loss FROM parts GROUP BY jet_id")
def event_mse(spark, sf_dir):
    rows = fx.particles(spark, sf_dir).withColumn("m", F.col("puppi") == 1)
    return rounded(stats.masked_mse(rows, "jet_id", "eta", "phi", "m"), "loss")


@register(f"{fx.WITH_PARTS}, b AS (SELECT label, jet_id, avg(mass) AS l, count(*) AS n FROM parts GROUP BY label, jet_id) SELECT label, round(sum(l * n) / sum(n), 6) AS loss FROM b GROUP BY label")
def weighted_loss(spark, sf_dir):
    """Means of batches (jets) weighted by their sizes."""
    batches = fx.particles(spark, sf_dir).groupBy("label", "jet_id").agg(F.avg("mass").alias("l"), F.count(F.lit(1)).alias("n"))
    return rounded(stats.weighted_mean(batches, "l", "n", "label", name="loss"), "loss")


@register(f"{fx.WITH_FEATURES} SELECT label, round(avg(d0_sig) FILTER (NOT isnan(d0_sig)), 6) AS loss FROM feats GROUP BY label")
def nanmean_loss(spark, sf_dir):
    return flat(featured(spark, sf_dir), "label").groupBy("label").agg(F.round(F.avg(stats.not_nan(F.col("d0_sig"))), 6).alias("loss"))


@register(f"{fx.WITH_JETS}, q AS (SELECT label, greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-(fj_pt - 250) / 5e1)))) AS p FROM jets) SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) AS bce FROM q")
def binary_cross_entropy(spark, sf_dir):
    rows = fx.jets(spark, sf_dir).select(sigmoid((F.col("fj_pt") - 250) / d(50.0)).alias("score"), "label")
    return rounded(stats.cross_entropy(rows, "label", "score"), "bce")


@register(f"{fx.WITH_JETS}, e AS (SELECT label, jet_id, fj_pt, min(fj_pt) OVER (PARTITION BY label ORDER BY jet_id) AS best, min(fj_pt) OVER (PARTITION BY label ORDER BY jet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM jets) SELECT label, jet_id, best, b IS NULL OR fj_pt < b AS improved FROM e")
def running_best(spark, sf_dir):
    rows = fx.jets(spark, sf_dir).select("label", "jet_id", "fj_pt")
    return stats.running_best(rows, "fj_pt", "jet_id", "label").drop("fj_pt")


# --- splits, unions, reshapes -------------------------------------------------------------------------------------


@register(f"{fx.WITH_JETS} SELECT jet_id, CASE WHEN row_number() OVER (ORDER BY jet_id) <= floor(count(*) OVER () * 8e-1) THEN 'train' ELSE 'test' END AS split FROM jets")
def split_80_20(spark, sf_dir):
    return splits.ordered_split(fx.jets(spark, sf_dir).select("jet_id"), "jet_id")


@register(f"{fx.WITH_JETS}, n AS (SELECT jet_id, row_number() OVER (ORDER BY jet_id) AS r, count(*) OVER () AS t, greatest(1, CAST(round_even(count(*) OVER () * 1e-1, 0) AS BIGINT)) AS k FROM jets) SELECT jet_id, CASE WHEN r <= t - 2 * k THEN 'train' WHEN r <= t - k THEN 'val' ELSE 'test' END AS split FROM n")
def split_train_val_test(spark, sf_dir):
    return splits.three_way_split(fx.jets(spark, sf_dir).select("jet_id"), "jet_id")


@register(f"{fx.WITH_JETS}, n AS (SELECT jet_id, row_number() OVER (ORDER BY jet_id) AS r, greatest(1, least(CAST(round_even(count(*) OVER () * 2e-1, 0) AS BIGINT), count(*) OVER () - 1)) AS k FROM jets) SELECT jet_id, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM n WHERE r <= k OR r - k <= 5000")
def test_first_split(spark, sf_dir):
    return splits.test_first_split(fx.jets(spark, sf_dir).select("jet_id"), "jet_id", max_train=5000)


@register(f"{fx.WITH_JETS}, n AS (SELECT jet_id, label, row_number() OVER (PARTITION BY label ORDER BY jet_id) AS r, (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM jets) AS m FROM jets) SELECT jet_id, label FROM n WHERE r <= m")
def balance_classes(spark, sf_dir):
    return splits.balanced(fx.jets(spark, sf_dir).select("jet_id", "label"), "label", "jet_id")


@register(f"""{fx.WITH_JETS}, n AS (SELECT jet_id, label, md5('42:' || jet_id) AS h, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || jet_id), jet_id) AS r, (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM jets) AS m FROM jets)
  SELECT jet_id, label, row_number() OVER (ORDER BY h, jet_id) AS position FROM n WHERE r <= m""")
def balanced_shuffle(spark, sf_dir):
    """Both classes cut to the smaller one's rows and shuffled together."""
    rows = fx.jets(spark, sf_dir)
    return splits.combined(*(rows.where(F.col("label") == y).select("jet_id") for y in (0, 1)), "label", "jet_id").select("jet_id", "label", F.col("position").cast("long").alias("position"))


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt, label FROM jets")
def union_labelled(spark, sf_dir):
    rows = fx.jets(spark, sf_dir)
    return splits.labelled_union(*(rows.where(F.col("label") == y).select("jet_id", "fj_pt") for y in (0, 1)))


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt FROM jets WHERE fj_pt > 300 UNION ALL SELECT jet_id, fj_pt FROM jets WHERE fj_pt < 100")
def union_strict(spark, sf_dir):
    rows = fx.jets(spark, sf_dir).select("jet_id", "fj_pt")
    return splits.union_strict([rows.where("fj_pt > 300"), rows.where("fj_pt < 100")])


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt FROM (SELECT * FROM jets ORDER BY jet_id LIMIT 100) WHERE fj_pt > 200 AND fj_pt < 400")
def cap_then_slice(spark, sf_dir):
    return select.pt_slice(splits.head(fx.jets(spark, sf_dir), 100, "jet_id"), lo=200, hi=400, inclusive=False).select("jet_id", "fj_pt")


@register(f"{fx.WITH_JETS} SELECT jet_id, fj_pt FROM jets WHERE fj_pt > 200 AND fj_pt < 400 ORDER BY jet_id LIMIT 100")
def slice_then_cap(spark, sf_dir):
    return splits.head(select.pt_slice(fx.jets(spark, sf_dir), lo=200, hi=400, inclusive=False), 100, "jet_id").select("jet_id", "fj_pt")


@register("SELECT o_orderpriority AS priority, " + ", ".join(f"CAST(count(*) FILTER (o_orderstatus = '{s}') AS BIGINT) AS \"{s}\"" for s in ("F", "O", "P")) + " FROM orders GROUP BY 1")
def status_pivot(spark, sf_dir):
    counted = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return splits.pivot_unique(counted, "priority", "status", "n", ["F", "O", "P"]).na.fill(0)


_GRID = {"learning_rate": [1e-5, 1e-4, 1e-3], "weight_decay": [0.0, 1e-5, 1e-4], "nearest_neighbors": [8, 16, 32], "smallest_dim": [8, 16]}


@register(f"""{fx.WITH_JETS}, runs AS (SELECT jet_id % 54 AS run_idx, count(*) AS n_jets, round(avg(fj_pt), 6) AS mean_pt FROM jets GROUP BY 1),
  g AS (SELECT *, row_number() OVER (ORDER BY learning_rate, weight_decay, nearest_neighbors, smallest_dim) - 1 AS run_idx FROM (VALUES (1e-5), (1e-4), (1e-3)) a(learning_rate), (VALUES (0e0), (1e-5), (1e-4)) b(weight_decay), (VALUES (8), (16), (32)) c(nearest_neighbors), (VALUES (8), (16)) e(smallest_dim))
  SELECT n_jets, mean_pt, CAST(learning_rate AS DOUBLE) AS learning_rate, CAST(nearest_neighbors AS BIGINT) AS nearest_neighbors, CAST(smallest_dim AS BIGINT) AS smallest_dim, round(log10(learning_rate), 6) AS log_lr, round(log10(CASE WHEN weight_decay = 0 THEN 1e-6 ELSE weight_decay END), 6) AS log_wd FROM g JOIN runs USING (run_idx)""")
def sweep_grid(spark, sf_dir):
    """The grid's settings joined to what the runs of the jets' table gave."""
    runs = fx.jets(spark, sf_dir).groupBy((F.col("jet_id") % 54).alias("run_idx")).agg(F.count(F.lit(1)).alias("n_jets"), F.round(F.avg("fj_pt"), 6).alias("mean_pt"))
    g = splits.sweep_grid(spark, **_GRID).join(runs, "run_idx")
    wd = F.when(F.col("weight_decay") == 0, d(1e-6)).otherwise(F.col("weight_decay"))
    return g.select("n_jets", "mean_pt", "learning_rate", "nearest_neighbors", "smallest_dim", F.round(log10_or_inf(F.col("learning_rate")), 6).alias("log_lr"), F.round(log10_or_inf(wd), 6).alias("log_wd"))


_RUNS = "runs AS (SELECT gen_idx AS run_idx, CASE WHEN gen_idx % 5 = 0 THEN NULL ELSE round(avg(fj_pt), 6) END AS auc FROM jets GROUP BY gen_idx)"


@register(f"{fx.WITH_JETS}, {_RUNS} SELECT run_idx, auc FROM runs ORDER BY auc DESC NULLS LAST, run_idx LIMIT 5")
def topk_runs(spark, sf_dir):
    runs = fx.jets(spark, sf_dir).groupBy(F.col("gen_idx").alias("run_idx")).agg(F.when(F.col("gen_idx") % 5 != 0, F.round(F.avg("fj_pt"), 6)).alias("auc"))
    return splits.top_runs(runs, 5, "auc", "run_idx")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
