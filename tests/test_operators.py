import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarkflow import streaming
from quarkflow.operators import features, graphs, metrics, models, scaling, select, splits, stats

LEP = "array<struct<pt:double,eta:double,phi:double>>"


def test_lead_jet_takes_first_of_equals_and_applies_every_cut(spark):
    jets = "array<struct<jet_id:long,pt:double,eta:double,phi:double,gen_idx:int>>"
    rows = [
        (1, [(1, 250.0, 0.0, 0.0, 0), (2, 300.0, 0.5, 1.0, 0), (3, 300.0, 0.1, 2.0, 0)], [], None),
        (2, [(4, 200.0, 0.0, 0.0, 0), (5, 400.0, 0.0, 0.0, 0)], [], None),  # strict bounds
        (3, [(6, 300.0, 2.0, 0.0, 0), (7, 250.0, 0.0, 0.0, 0)], [(30.0, 0.0, 0.4)], None),  # eta, lepton at 0.4
        (4, [(8, 300.0, 0.0, 0.0, 0)], [(10.0, 0.0, 0.0)], [(50.0, 1.0, 3.0)]),  # soft or far leptons
        (5, [], None, None),
    ]
    df = spark.createDataFrame(rows, f"event long, jets {jets}, electrons {LEP}, muons {LEP}")
    assert {r.event: r.jet_id for r in streaming.lead_jets(df, 200, 400).collect()} == {1: 2, 4: 8}


def test_truth_match(spark):
    df = spark.createDataFrame([(-1,), (2,), (0,), (1,)], "i int").withColumn("g", F.lit(None).cast(LEP))
    gen = F.array(*(F.struct(F.lit(e).alias("eta"), F.lit(0.0).alias("phi")) for e in (0.4, 0.39)))
    got = df.select(select.matched(F.lit(0.0), F.lit(0.0), F.col("i"), gen)).collect()
    assert [r[0] for r in got] == [False, False, False, True]


def test_windows(spark):
    df = spark.createDataFrame([(200.0,), (300.0,)], "fj_pt double")
    assert select.pt_slice(df, lo=200).count() == 2 and select.pt_slice(df, lo=200, inclusive=False).count() == 1 and select.pt_slice(df).count() == 2
    with pytest.raises(ValueError):
        select.pt_slice(df, "other")


PART = "array<struct<idx:int,pt:double,eta:double,phi:double,d0:double,d0_err:double,dz:double,dz_err:double,puppi:double,pdg_id:int>>"


def test_features_and_bounds(spark):
    parts = [(i, 1.0, dr, 0.0, 0.2, 0.1, 0.2, 0.1, w, 211) for i, (dr, w) in enumerate([(0.1, 1.0), (0.9, 1.0), (0.8, 1.0), (0.2, 0.5)])]
    df = spark.createDataFrame([(1, parts), (2, [])], f"jet_id long, parts {PART}").withColumn("parts", features.with_features(F.col("parts")))
    rows = {r.jet_id: r for r in df.select("jet_id", features.within_bounds(F.col("parts")).alias("at"), features.bounded(F.col("parts")).alias("kept")).collect()}
    assert rows[1]["at"] == [0, 2] and [p["idx"] for p in rows[1].kept] == [0, 2] and rows[2]["at"] == []
    out = streaming.scaled_particles(df.withColumn("parts", F.transform("parts", lambda p: p)), {"pt": ("scale", 0.0, 2.0)}, ("pt", "dr")).where("jet_id = 1").first()
    assert out.pt == pytest.approx([0.0, 0.0], abs=1e-5) and out.dr == [0.1, 0.8]


def test_feature_helpers(spark):
    assert features.feature_list(" a, b ,,c") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        features.feature_list(" , ")
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert features.valid_rows(df, "a", ["b"]).count() == 1
    with pytest.raises(ValueError):
        features.valid_rows(df, "a", ["z"])
    assert df.select(features.stacked(["a", "b"])).first()[0] == [[1.0, 3.0], [2.0, 4.0]]
    values, mask = features.padded(F.col("a"), 3)
    assert [list(r) for r in df.select(values, mask).collect()] == [[[1.0, 2.0, 0.0], [1, 1, 0]], [[1.0, 0.0, 0.0], [1, 0, 0]]]
    assert df.select(features.gather(F.col("a"), F.array(F.lit(1), F.lit(5)))).first()[0] == [2.0, None]


def test_scalers_and_degenerate_ones(spark):
    rows = [("good", float(x)) for x in (1, 2, 4, 9)] + [("flat", 5.0)] * 3 + [("none", 0.0), ("none", math.nan), ("pdg_1", 1.0), ("pdg_1", 7.0)]
    s = scaling.percentile_scalers(spark.createDataFrame(rows, "feature string, value double"))
    t = scaling.scaler_table(s)
    assert t["good"] == ("scale", pytest.approx(1.48), pytest.approx(6.6)) and t["flat"][0] == t["none"][0] == "uninformative"
    z = {r.feature: r.scaled_zero for r in scaling.scaled_zero(s).collect()}
    assert z["flat"] == 0 and math.isnan(z["pdg_1"]) and z["good"] == pytest.approx(-1.578124887)
    got = spark.range(1).select(*(scaling.scale(F.lit(float(x)), F.lit(1.48), F.lit(6.6)) for x in (0, 2, 9))).first()
    assert list(got) == pytest.approx([-1.578124887, -0.796875040, 1.937499426])
    df = spark.createDataFrame([([1.0], [2.0], [3.0])], "good array<double>, pdg_x array<double>, other array<double>")
    out = df.select(*(c.alias(n) for n, c in scaling.apply_scalers({c: F.col(c) for c in df.columns}, t | {"pdg_x": ("scale", 0.0, 1.0)}).items())).first()
    assert out.pdg_x == [2.0] and out.other == [3.0] and out.good[0] == pytest.approx((1 - 1.48) / (5.12 + 1e-6) * 2 - 1)


NODE = "jet_id long, idx int, pt double, eta double, phi double, mass double, fj_msoftdrop double"


def nodes(spark, pt, eta, phi, mass):
    return spark.createDataFrame([(1, i, *map(float, v), 2.0) for i, v in enumerate(zip(pt, eta, phi, mass))], NODE)


def edges(df):
    return {(r.center, r.neighbor): r.d for r in df.collect()}


def test_nearest_in_plane_and_clamping(spark):
    df = nodes(spark, [1] * 4, [0, 1, 3, 7], [0] * 4, [0] * 4)
    assert set(edges(graphs.build(df, "eta_phi", 1))) == {(0, 1), (1, 0), (2, 1), (3, 2)}
    three = df.where("idx < 3")
    assert graphs.build(three, "eta_phi", 16).count() == 6 and graphs.build(three, "fully_connected", 16).count() == 9
    assert graphs.build(three, "mass_knn", 16).count() == 9 and graphs.build(three, "hybrid_knn", 16).count() == 9
    for m in graphs.METHODS:
        assert graphs.build(df.where("idx = 0"), m, 3, ["pt"]).count() == 0
    with pytest.raises(ValueError):
        graphs.build(df, "other", 1)
    assert graphs.undirected(graphs.build(df, "eta_phi", 1)).count() == 3


def test_mass_and_hybrid_distances(spark):
    df = nodes(spark, [1, 1, 0.5], [0, 0, 1], [0, 1, 0], [0, 0, 0.1])
    mass = edges(graphs.build(df, "mass_knn", 2))
    assert [mass[p] for p in ((0, 1), (0, 2), (1, 2), (2, 2))] == pytest.approx([1.042914, 1.329217, 0.987399, 4.999975], rel=1e-5)
    mixed = edges(graphs.build(df, "hybrid_knn", 2, alpha=0.5))
    assert [mixed[p] for p in ((0, 1), (0, 2), (1, 2))] == pytest.approx([1.396467, 1.682771, 1.487399], rel=1e-5)


def scores(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auc_with_ties_and_symmetry(spark):
    df = scores(spark, [(0, 1.0), (0, 2.0), (0, 2.0), (1, 2.0), (1, 3.0), (1, math.nan), (1, None)])
    assert metrics.roc_auc(df).first().auc == pytest.approx(5 / 6)
    rng = np.random.default_rng(0)
    rows = [(int(y), float(round(s, 1))) for y, s in zip(rng.integers(0, 2, 500), rng.normal(size=500))]
    a = metrics.roc_auc(scores(spark, rows)).first().auc
    b = metrics.roc_auc(scores(spark, [(y, -s) for y, s in rows])).first().auc
    p, n = np.array([s for y, s in rows if y]), np.array([s for y, s in rows if not y])
    assert a == pytest.approx((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2) and a + b == pytest.approx(1)
    curve = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(scores(spark, rows)).collect())
    assert curve[-1] == (1.0, 1.0) and all(x[1] <= y[1] for x, y in zip(curve, curve[1:]))
    assert metrics.roc_auc(scores(spark, [(1, 1.0)])).first().auc is None
    assert metrics.roc_auc(scores(spark, [])).count() == 1


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, 1.0, 2.0, math.nan)], "x double")
    got = sorted((r.bin, r.n, r.density) for r in stats.histogram(df, "x", 4).collect())
    assert [g[1] for g in got] == [1, 1, 2, 1] and [g[2] for g in got] == pytest.approx([0.4, 0.4, 0.8, 0.4])


def test_splits(spark):
    for n, train in ((1, 0), (5, 4), (7, 5), (10, 8)):
        assert splits.ordered_split(spark.range(n), "id").where("split = 'train'").count() == train
    for n, k in ((25, 2), (35, 4), (45, 4), (5, 1)):
        rows = splits.three_way_split(spark.range(n), "id").groupBy("split").count().collect()
        assert {r.split: r["count"] for r in rows} == {"train": n - 2 * k, "val": k, "test": k}
    got = splits.test_first_split(spark.range(10), "id", 0.2, max_train=3).collect()
    assert sorted((r.id, r.split) for r in got) == [(0, "test"), (1, "test"), (2, "train"), (3, "train"), (4, "train")]
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id long, label int")
    assert splits.balanced(df, "label", "id").groupBy("label").count().collect()[0]["count"] == 3
    assert [r.rn for r in splits.numbered(spark.range(2000).repartition(7), "id").orderBy("id").collect()] == list(range(1, 2001))


def test_unions_pivot_and_grid(spark):
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, a int")
    with pytest.raises(ValueError):
        splits.union_strict([a, b])
    assert splits.union_loose([a, b.drop("a")]).count() == 2 and splits.labelled_union(a, a).where("label = 1").count() == 1
    cells = spark.createDataFrame([(1, "x", 5.0), (1, "y", 6.0)], "r int, c string, v double")
    assert splits.pivot_unique(cells, "r", "c", "v").first().asDict() == {"r": 1, "x": 5.0, "y": 6.0}
    with pytest.raises(Exception, match="repeated cell"):
        splits.pivot_unique(cells.union(cells), "r", "c", "v", ["x", "y"]).collect()
    assert splits.sweep_grid(spark, a=[1, 2, 3], b=[1, 2, 3], c=[1, 2, 3], d=[1, 2]).count() == 54
    top = splits.top_runs(spark.createDataFrame([(1, 0.5), (2, math.nan), (3, None), (4, 0.9)], "i int, auc double"), 2, "auc", "i")
    assert [r.i for r in top.collect()] == [4, 1]


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        cost = rng.random((n, m)).round(2)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
        rows, columns = models.assignment(cost)
        assert len(set(rows)) == len(set(columns)) == min(n, m) and cost[rows, columns].sum() == pytest.approx(best)


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[3, 1, 0], [0, 1, 0], [0, 0, 0.1]]) + 5
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    rows, ratio = models.pca(df, ["a", "b", "c"])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([r.pc for r in rows.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T)) and ratio == pytest.approx((s**2 / (s**2).sum())[:2])
    err = [r.score for r in models.linear_reconstruction(df, df, ["a", "b", "c"], 2).orderBy("id").collect()]
    assert np.allclose(err, ((c - c @ vt[:2].T @ vt[:2]) ** 2).mean(1))
    with pytest.raises(ValueError):
        models.pca(df, ["a"])
    y = (x[:, :1] * 2 - x[:, 1:2]) / 5
    z = (x - x.mean(0)) / x.std(0)
    net = models.Mlp((3, 16, 1)).fit(z[:150], y[:150], (z[150:], y[150:]), epochs=40)
    assert net.history[-1]["val_loss"] < 0.2 * net.history[0]["val_loss"]
    assert models.EdgeConvEncoder(4).reconstruct(rng.normal(size=(5, 4))).shape == (5, 4)
    out, latent = models.TokenEncoder(4).forward(rng.normal(size=(5, 4)), np.array([True] + [False] * 4))
    assert out.shape == (5, 4) and latent.shape == (16,)


def test_running_best_and_losses(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 4.0)], "epoch int, loss double").withColumn("run", F.lit(1))
    assert [r.improved for r in stats.running_best(df, "loss", "epoch", "run").orderBy("epoch").collect()] == [True, False, True]
    m = spark.createDataFrame([(1, 1.0, 3.0, True), (1, 0.0, 9.0, False), (2, 1.0, 1.0, False)], "k int, t double, o double, m boolean")
    assert {r.k: r.loss for r in stats.masked_mse(m, "k", "t", "o", "m").collect()} == {1: 4.0, 2: 0.0}


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(str(k), float(x)) for k in range(3) for x in rng.normal(size=700 * k + 3).round(2)] + [(None, 4.0), ("0", None)]
    got = {r.k: r.q for r in stats.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", (0.0, 0.16, 0.5, 0.84, 1.0), "k").collect()}
    for k in ("0", "1", "2", None):
        x = [v for key, v in rows if key == k and v is not None]
        assert got[k] == pytest.approx(np.percentile(x, [0, 16, 50, 84, 100]))
    flat = spark.createDataFrame([(2.0,)] * 50, "x double")
    assert stats.exact_quantiles(flat, "x", (0.3,)).first().q == [2.0] and stats.exact_quantiles(flat.limit(0), "x", (0.3,)).count() == 0


def test_exact_quantiles_narrow_their_bands(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_BAND", 20)
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=30_000), "b": np.concatenate([np.full(20_000, 3.0), rng.normal(size=10_000)]), "c": np.array([5.0]), "d": np.concatenate([rng.normal(size=9_000), [np.inf, -np.inf]])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("e", None), ("e", float("nan"))], "k string, x double")
    got = {r.k: r.q for r in stats.exact_quantiles(df, "x", (0.0, 0.16, 0.5, 0.84), "k").collect()}
    assert got.pop("e") is None
    for k, q in got.items():
        x = np.sort(values[k])
        want = np.quantile(x[np.isfinite(x)], [0, 0.16, 0.5, 0.84])
        assert q == pytest.approx(want if k != "d" else [-np.inf, *np.quantile(x, [0.16, 0.5, 0.84])])


@pytest.mark.parametrize("kind", ["bigint", "string", "double", "timestamp"])
def test_numbers_follow_the_order_of_any_column(spark, kind):
    df = spark.range(500).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") * 7919 % 503).alias("v"), "id")
    df = df.select(F.lpad(F.col("v").cast("string"), 3, "0").alias("v") if kind == "string" else F.timestamp_seconds("v").alias("v") if kind == "timestamp" else (F.col("v") + 2**60).cast(kind).alias("v") if kind == "bigint" else F.col("v").cast(kind).alias("v"), "id")
    got = [(r.v is not None, r.v, r.id) for r in splits.numbered(df, "v", "id").orderBy("rn").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1] if r[0] else 0, r[2])) and len(got) == 500
    assert [r.rn for r in splits.numbered(df, "v", "id").orderBy("rn").collect()] == list(range(1, 501))


def test_running_best_by_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k == 2 else k, i, float(v)) for k in range(3) for i, v in enumerate(rng.integers(0, 1000, 300))]
    for smallest in (True, False):
        got = {(r.k, r.i): (r.best, r.improved) for r in stats.running_best(spark.createDataFrame(rows, "k int, i int, v double").repartition(5), "v", "i", "k", smallest=smallest).collect()}
        for k in (0, 1, None):
            best = None
            for _, i, v in [r for r in rows if r[0] == k]:
                better = best is None or (v < best if smallest else v > best)
                best = v if better else best
                assert got[k, i] == (best, better)


def test_a_three_way_split_needs_three_rows(spark):
    with pytest.raises(Exception, match="needs 3 rows"):
        splits.three_way_split(spark.range(2), "id").collect()


def test_arrays_of_several_lengths_are_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [3.0, 4.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="not as long"):
        features.checked_rows(df, "a", ["b"]).collect()
    with pytest.raises(ValueError):
        features.checked_rows(df, "a", ["z"])
    assert features.checked_rows(df.limit(1), "a", ["b"]).count() == 1
    with pytest.raises(Exception, match="not as long"):
        features.node_stack(df, ["a", "b"]).collect()
    assert features.node_stack(df.limit(1), ["a", "b"]).first().x == [[1.0, 3.0], [2.0, 4.0]]
    with pytest.raises(Exception, match="2 elements for 1 slots"):
        df.where(features.within_capacity(F.col("b"), 1)).collect()
    assert df.where(features.within_capacity(F.col("b"), 2)).count() == 2


def test_top_k_pool(spark):
    nodes = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 3.0), (2, 0, math.nan)], "jet_id int, idx int, x double")
    edges = spark.createDataFrame([(1, 1, 2), (1, 0, 1), (1, 2, 0)], "jet_id int, center int, neighbor int")
    kept, between = graphs.top_k_pool(nodes, edges, ["x"], [2.0])
    t = math.tanh(3.0)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 1, pytest.approx(3 * t), pytest.approx(t)), (1, 2, pytest.approx(3 * t), pytest.approx(t)), (2, 0, 0.0, 0.0)]
    assert [(r.center, r.neighbor) for r in between.collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        graphs.top_k_pool(nodes, edges, ["x"], [0.0])


def test_index_loss(spark):
    rows = spark.createDataFrame([(1, 1.0, 3.0, True), (1, 0.0, 9.0, False), (2, 1.0, 1.0, False), (3, 2.0, 1.0, True)], "e int, t double, o double, ok boolean")
    assert sorted(tuple(r) for r in stats.index_loss(rows, [("t", "o")], "ok", "e").collect()) == [(1, 4.0), (2, 0.0), (3, 1.0)]
    assert stats.index_loss(rows, [("t", "o")], "ok").first().loss == 2.5
    assert stats.index_loss(rows.where("not ok"), [("t", "o")], "ok").first().loss is None
