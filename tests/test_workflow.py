import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarkflow import cli, config
from quarkflow.functions.expr import safe_name
from quarkflow.operators import models, sweeps
from quarkflow.plans import workflow

EVENTS = """event_id long, FatJet_pt array<double>, FatJet_eta array<double>, FatJet_phi array<double>, FatJet_mass array<double>, FatJet_genJetAK8Idx array<int>,
  GenJetAK8_eta array<double>, GenJetAK8_phi array<double>, Electron_pt array<double>, Electron_eta array<double>, Electron_phi array<double>,
  Muon_pt array<double>, Muon_eta array<double>, Muon_phi array<double>, FatJetPFCands_jetIdx array<int>, FatJetPFCands_pFCandsIdx array<int>,
  PFCands_pt array<double>, PFCands_eta array<double>, PFCands_phi array<double>, PFCands_d0 array<double>, PFCands_d0Err array<double>,
  PFCands_dz array<double>, PFCands_dzErr array<double>, PFCands_puppiWeight array<double>, PFCands_pdgId array<int>"""


def event(i, pt=(250.0, 300.0), gen=(0, 1), muons=((), (), ()), bridge=((0, 1, 1), (0, 1, 2))):
    n = 3
    return (
        i, list(pt), [0.0, 1.0], [0.0, 2.0], [5.0, 6.0], list(gen), [0.1, 1.1], [0.0, 2.0], None, None, None, *(list(m) for m in muons), *(list(b) for b in bridge),
        [30.0, 60.0, 90.0 + i], [0.1, 1.2, 1.3], [0.0, 2.1, 2.2], [0.2, 0.3, 0.4], [0.1] * n, [0.2] * n, [0.1, 0.2, 0.0], [1.0, 1.0, 1.0], [211, 22, -211],
    )


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def test_preprocess(spark):
    df = events(spark, event(1), event(2, gen=(0, -1)), event(3, gen=(5, 5)), event(4, muons=((25.0,), (1.0,), (2.3,))), event(5, bridge=((0,), (0,))), event(6, pt=(100.0, 500.0)))
    got = {r.jet_id: r for r in workflow.preprocess(df, 200, 400).collect()}
    assert set(got) == {1, 2, 4}  # 3: no truth; 5: no constituents of the leading jet; 6: outside the window
    assert got[1].fj_pt == 300 and got[1].pt == pytest.approx([60 / 300, 91 / 300]) and got[1].eta == pytest.approx([0.2, 0.3]) and got[1].pdgId == [22, -211]
    assert got[2].fj_pt == 250 and got[4].fj_pt == 250 and got[1].fj_mass == 6


def test_process_and_command_line(spark, tmp_path, capsys):
    bg, sg = str(tmp_path / "bg"), str(tmp_path / "sg")
    events(spark, *(event(i) for i in range(1, 9))).write.parquet(bg)
    events(spark, *(event(i) for i in range(20, 23))).write.parquet(sg)
    out = str(tmp_path / "out")
    for path, kind in ((bg, "background"), (sg, "signal")):
        assert cli.main(["preprocess", path, out, "--type", kind, "--lowerpt", "200", "--upperpt", "400", "--max-events", "100"]) == 0
    cli.main(["process", f"{out}/background", f"{out}/signal", f"{out}/scaled", "--features", "log_pt,dr"])
    rows = spark.read.parquet(f"{out}/scaled/signal_scaled").collect()
    assert len(rows) == 3 and all(len(r.log_pt) == 2 and r.within_bounds == [0, 1] for r in rows)
    assert rows[0].pdg_22 == [1, 0] and rows[0].pdg_m211 == [0, 1]  # codes of both tables, in bounds
    raw, scaled = (spark.read.parquet(f"{out}/scaled/other/background_{n}") for n in ("rawvals", "scaledvals"))
    assert raw.count() == scaled.count() == 32 and {r.feature for r in raw.collect()} == {"log_pt", "dr"}
    scalers = {r.feature: r for r in spark.read.parquet(f"{out}/scaled/scalers").collect()}
    for name in ("log_pt", "dr"):
        lo, hi = scalers[name].p16, scalers[name].p84
        want = sorted((r.value - lo) / (hi - lo + 1e-6) * 2 - 1 for r in raw.where(f"feature = '{name}'").collect())
        assert sorted(r.value for r in scaled.where(f"feature = '{name}'").collect()) == pytest.approx(want)
        (zero,) = [r.scaled_zero for r in spark.read.parquet(f"{out}/scaled/other/signal_zero").collect() if r.feature == name]
        assert zero == pytest.approx((0 - lo) / (hi - lo + 1e-6) * 2 - 1)
    cli.main(["concat", f"{out}/background", f"{out}/signal", "--name", f"{out}/all"])
    capsys.readouterr()
    cli.main(["info", f"{out}/all"])
    assert json.loads(capsys.readouterr().out)["rows"] == 11
    cli.main(["split", f"{out}/all", f"{out}/split", "--order", "jet_id"])
    assert spark.read.parquet(f"{out}/split").groupBy("split").count().count() == 3
    spark.createDataFrame([(0, 0.2), (1, 0.9)], "label int, score double").write.parquet(f"{out}/scores")
    capsys.readouterr()
    cli.main(["evaluate", f"{out}/scores"])
    assert json.loads(capsys.readouterr().out)["auc"] == 1.0


def test_the_whole_chain_and_distributions(spark, tmp_path):
    for name, ids in (("a", range(1, 5)), ("b", range(5, 9)), ("s", range(20, 23))):
        events(spark, *(event(i) for i in ids)).write.parquet(f"{tmp_path}/{name}")
    args = ["prepare", f"{tmp_path}/s", f"{tmp_path}/a", f"{tmp_path}/b", "--output", f"{tmp_path}/out", "--features", "log_pt,dr", "--lowerpt", "200", "--upperpt", "400"]
    assert cli.main(args) == 0
    assert spark.read.parquet(f"{tmp_path}/out/background").count() == 8 and spark.read.parquet(f"{tmp_path}/out/processed/background_scaled").count() == 8
    import shutil

    shutil.rmtree(tmp_path / "out" / "processed" / "scalers")  # a step that is missing is made, the others stay as they are
    before = (tmp_path / "out" / "background" / "_SUCCESS").stat().st_mtime_ns
    assert cli.main(args) == 0 and spark.read.parquet(f"{tmp_path}/out/processed/scalers").count() == 2
    assert (tmp_path / "out" / "background" / "_SUCCESS").stat().st_mtime_ns == before
    rows = [(i, [float(i), float("nan"), 0.0]) for i in range(1, 11)]
    spark.createDataFrame(rows, "jet_id long, pt array<double>").write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([(1, [20.0])], "jet_id long, pt array<double>").write.parquet(f"{tmp_path}/y")
    cli.main(["distributions", f"{tmp_path}/x", f"{tmp_path}/y", "--output", f"{tmp_path}/h", "--bins", "4", "--scaled-zero", "0"])
    got = sorted((r.dataset, r.bin, r.lo, r.hi, r.n) for r in spark.read.parquet(f"{tmp_path}/h").collect())
    assert got == [(0, 0, 1.0, 5.75, 5), (0, 1, 5.75, 10.5, 5), (1, 3, 15.25, 20.0, 1)]
    cli.main(["distributions", f"{tmp_path}/x", "--output", f"{tmp_path}/i", "--prop", "jet_id", "--bins", "2", "--lower", "0", "--upper", "4"])
    assert sorted((r.bin, r.n) for r in spark.read.parquet(f"{tmp_path}/i").collect()) == [(0, 1), (1, 3)]


def test_features_one_hots_muons_and_lengths(spark):
    table = workflow.preprocess(events(spark, event(1), event(2)), 200, 400)
    rows = workflow.add_features(table, [22, -211]).select("parts").collect()
    assert [[(p.pdg_id, p.pdg_22, p.pdg_m211) for p in r.parts] for r in rows] == [[(22, 1, 0), (-211, 0, 1)]] * 2
    muons = table.withColumn("pdgId", F.array(F.lit(13), F.lit(-13))).withColumn("pt", F.array(F.lit(0.3), F.lit(0.5)))
    assert [[p.pt for p in r.parts] for r in workflow.add_features(muons, [13], mask_muons=True).collect()] == [[0.5]] * 2
    with pytest.raises(Exception, match="is not as long as pt"):
        workflow.add_features(table.withColumn("eta", F.array(F.lit(0.1)))).collect()


def test_training_from_the_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    for name, first, turn in (("bg", 0, 0.0), ("sg", 1000, 1.5)):
        rows = [(first + i, *[(rng.normal(size=n) + turn * (c == 3)).tolist() for c in range(4)]) for i, n in enumerate(rng.integers(2, 6, 60).tolist())]
        spark.createDataFrame(rows, "jet_id long, eta array<double>, phi array<double>, pt array<double>, mass array<double>").write.parquet(f"{tmp_path}/{name}")
    sizes = {"GraphAutoencoder": {"width": 4, "smallest": 2, "layers": 1, "wide": 2}, "EdgeConvClassifier": {"smallest": 4, "k": 2, "reduced_k": 2}}
    for model, config_ in sizes.items():
        out = f"{tmp_path}/{model}"
        args = ["train", f"{tmp_path}/bg", f"{tmp_path}/sg", out, "--model", model, "--config", json.dumps(config_), "--epochs", "2", "--steps", "2"]
        assert cli.main(args) == 0
        about = json.loads(spark.read.text(f"{out}/summary.json", wholetext=True).first().value)
        assert about["model"] == model and len(about["history"]) == 2 and 0 <= about["auc"] <= 1
        assert spark.read.parquet(f"{out}/scores").count() == about["n_pos"] + about["n_neg"]
    capsys.readouterr()
    cli.main(["latents", f"{tmp_path}/GraphAutoencoder/model", f"{tmp_path}/bg", f"{tmp_path}/z"])
    z = spark.read.parquet(f"{tmp_path}/z").collect()
    assert len(z) == 60 and all(len(r.z) == 2 == len(r.pc) for r in z)


def test_default_paths(spark, tmp_path):
    from quarkflow.sources.readers import default_path

    (tmp_path / "x").mkdir()
    for session in (None, spark):
        assert default_path(None, str(tmp_path), session) == str(tmp_path) and default_path("x", str(tmp_path), session) == f"{tmp_path}/x"
        assert default_path(str(tmp_path / "x"), "/nowhere", session) == str(tmp_path / "x")
        with pytest.raises(FileNotFoundError):
            default_path("y", str(tmp_path), session)


def test_sweeps_and_names(spark):
    found = sweeps.run_sweep(spark, lambda p: {"auc": p["a"] / 10}, a=[1, 2], b=[5])
    assert sorted((r.run_idx, r.auc) for r in found.collect()) == [(0, 0.1), (1, 0.2)]
    runs = spark.createDataFrame([(0,), (1,)], "run_idx int")
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 1, 2.0)], "run_idx int, label int, score double")
    assert sorted((r.run_idx, r.auc) for r in sweeps.auc_by_run(runs, scores).collect()) == [(0, 0.75), (1, None)]
    assert sweeps.best_run(spark, {0: scores, 1: scores.where("label = 1")}) == (0, 0.75)
    a, b = spark.createDataFrame([("ab",), ("x",)], "r string"), spark.createDataFrame([("zabz",), ("abab",), ("q",)], "p string")
    assert sorted(tuple(r) for r in sweeps.match_names(a, b, "r", "p").collect()) == [("ab", "abab"), ("ab", "zabz")]


def test_settings_and_weights(tmp_path):
    (tmp_path / "c.json").write_text('{"knn": 3, "max_events": null}')
    assert config.load(str(tmp_path / "c.json")).knn == 3 and config.Settings().override(alpha=0.5).alpha == 0.5
    with pytest.raises(ValueError):
        config.Settings().override(other=1)
    x = np.random.default_rng(0).normal(size=(6, 4))
    for model, apply in ((models.Mlp((4, 3, 2)), lambda m: m.predict(x)), (models.EdgeConvEncoder(4), lambda m: m.reconstruct(x))):
        path = str(tmp_path / f"{type(model).__name__}.npz")
        models.save_weights(model, path)
        assert np.allclose(apply(models.load_weights(path, type(model))), apply(model))
    with pytest.raises(TypeError):
        models.load_weights(str(tmp_path / "Mlp.npz"), models.EdgeConvEncoder)


def test_best_epochs_slices_and_repeats(spark):
    rows = [(0, 0, 0.8, 1.0), (0, 1, 0.8, 0.5), (0, 2, 0.7, 0.1), (0, 3, None, 0.0), (0, 4, 0.8, None), (1, 0, float("nan"), 0.0)]
    epochs = spark.createDataFrame(rows, "run int, epoch int, auc double, loss double")
    assert [tuple(r) for r in sweeps.best_epoch(epochs, "run").collect()] == [(0, 1, 0.8, 0.5)]
    assert sweeps.best_epoch(epochs.where("run = 0")).first().epoch == 1 and sweeps.best_epoch(epochs.limit(0)).count() == 0
    assert sorted(r.epoch for r in sweeps.at_setting(epochs, run=0, auc=None).collect()) == [3]
    assert sweeps.with_auc(epochs).count() == 4
    scored = sweeps.repeat_mean(epochs.where("run = 0"), lambda df: df.withColumn("x", df.repeat + df.epoch), 3, "x", "epoch")
    assert sorted(tuple(r) for r in scored.collect()) == [(i, i + 1.0) for i in range(5)]
    with pytest.raises(ValueError):
        sweeps.repeat_mean(epochs, lambda df: df, 0, "auc")


def test_safe_name():
    assert safe_name("a/b") == "a_b"
