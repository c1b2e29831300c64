"""Networks, gradient steps, snapshots and sweeps, against plain NumPy."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest

from quarkflow.operators import gradients, networks, sweeps, training
from quarkflow.operators.training import Moments, Plan
from quarkflow.sources import snapshots

NETWORKS = {
    "classifier": networks.EdgeConvClassifier(4, smallest=3, k=2, reduced_k=2),
    "graph": networks.GraphAutoencoder(4, width=5, smallest=2, layers=2, k=2, wide=2),
    "graph_one_layer": networks.GraphAutoencoder(4, width=5, smallest=2, layers=1, k=3, wide=2),
    "masked": networks.MaskedTransformer(4, width=6, layers=2, ratio=0.5),
    "class_set": networks.ClassTokenAutoencoder(4, width=6, layers=1, latent=3, slots=8),
    "class_index": networks.ClassTokenAutoencoder(4, width=6, layers=1, latent=3, slots=8, loss="index"),
    "tokens": networks.TokenAutoencoder(4, width=6, layers=1, latent=2),
}
SIZES = (2, 3, 5, 4, 7, 2)


def jet_rows(sizes=SIZES, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, i % 2, rng.normal(size=(n, 4)).tolist()) for i, n in enumerate(sizes)]


def batch_of(rows):
    return pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "key": [r[0] for r in rows], "label": [r[1] for r in rows], "x": [r[2] for r in rows]})


def numpy_jets(rows, mean=np.zeros(4), std=np.ones(4), size=256):
    return list(networks.jets_of(batch_of(rows), mean, std, size))


@pytest.mark.parametrize("name", NETWORKS)
def test_gradients_are_finite_differences(name):
    net, (jets,) = NETWORKS[name], numpy_jets(jet_rows())
    flat = net.initial(3) + 0.05 * np.random.default_rng(1).normal(size=net.size())

    def value(p):
        values, weight = net.losses(net.weights(p), jets, 5, True)
        return float((values.value * weight).sum())

    w = net.weights(flat)
    values, weight = net.losses(w, jets, 5, True)
    (values * weight).sum().backward()
    got = np.concatenate([(n.grad if n.grad is not None else np.zeros(n.shape)).ravel() for n in w.values()])
    eye = 1e-6 * np.eye(len(flat))
    want = np.array([(value(flat + e) - value(flat - e)) / 2e-6 for e in eye])
    assert np.abs(got - want).max() < 1e-6 * max(1, np.abs(want).max())


@pytest.mark.parametrize("name", NETWORKS)
def test_a_jet_is_scored_alike_alone_and_among_others(name):
    """Padding and company change nothing."""
    net, rows = NETWORKS[name], jet_rows()
    w = net.weights(net.initial(3))
    (together,) = numpy_jets(rows)
    among = dict(zip(together.ids.tolist(), net.scores(w, together, 9).tolist()))
    latent = dict(zip(together.ids.tolist(), net.latents(w, together).tolist()))
    for row in rows:
        (alone,) = numpy_jets([row])
        assert net.scores(w, alone, 9)[0] == pytest.approx(among[row[0]], abs=1e-12)
        assert net.latents(w, alone)[0].tolist() == pytest.approx(latent[row[0]], abs=1e-12)


def test_jets_are_read_from_list_buffers():
    rows = jet_rows((3, 2, 6, 2))
    batch = batch_of([*jet_rows((4,), 9), *rows]).slice(1)
    mean, std = np.arange(4.0), np.full(4, 2.0)
    seen = {}
    for jets in networks.jets_of(batch, mean, std, 3):
        assert len(jets.ids) <= 3
        for i, n in enumerate(jets.counts.tolist()):
            seen[int(jets.ids[i])] = (jets.x[i, :n], jets.place[i, :n], jets.x[i, n:])
    for i, _, x in rows:
        assert np.allclose(seen[i][0], (np.array(x) - mean) / std) and np.allclose(seen[i][1], np.array(x)[:, :2]) and not seen[i][2].any()


def test_jets_together_are_bounded_by_their_pairs_of_nodes(monkeypatch):
    """A batch of large jets, or of small ones with many slots, is cut into smaller groups; every jet comes once. Small jets stay together."""
    rows = jet_rows((2, 40, 3, 2, 90, 41, 5, 40))
    sizes = lambda least=0: [(len(j.ids), j.valid.shape[1]) for j in networks.jets_of(batch_of(rows), np.zeros(4), np.ones(4), 256, least)]
    assert sizes() == [(8, 90)]
    monkeypatch.setattr(networks, "PAIRS", 3400)
    assert sizes() == [(4, 5), (2, 40), (1, 41), (1, 90)]
    assert sizes(34) == [(2, 2), (2, 5), (2, 40), (1, 41), (1, 90)]
    jets = list(networks.jets_of(batch_of(rows), np.zeros(4), np.ones(4), 256))
    assert sorted(i for j in jets for i in j.ids.tolist()) == list(range(8))
    net = NETWORKS["tokens"]
    w = net.weights(net.initial(3))
    parts = {i: s for j in jets for i, s in zip(j.ids.tolist(), net.scores(w, j, 0).tolist())}
    monkeypatch.setattr(networks, "PAIRS", 1 << 18)
    (whole,) = numpy_jets(rows)
    assert parts == pytest.approx(dict(zip(whole.ids.tolist(), net.scores(w, whole, 0).tolist())), abs=1e-12)
    assert networks.ClassTokenAutoencoder(4, width=6, layers=1, latent=3, slots=500).least() == 500 and net.least() == 0


def test_edge_convolution_equals_loops():
    """Against the definition, node by node; neighbours by distance, ties by number; a lone node gets zeros."""
    rng = np.random.default_rng(4)
    rows = [(0, 0, rng.normal(size=(5, 4)).tolist()), (1, 0, rng.normal(size=(1, 4)).tolist()), (2, 0, np.repeat(rng.normal(size=(1, 4)), 3, 0).tolist())]
    (jets,) = numpy_jets(rows)
    shapes = networks.edge_shapes("c", 4, 6, 3)
    w = {n: gradients.Node(rng.normal(size=s)) for n, s in shapes.items()}
    got = networks.edge_conv(w, "c", gradients.Node(jets.x), networks.nearest(jets.place, jets.valid, 2), 0.1).value
    for j, jet in enumerate(jets.ids.tolist()):
        x = np.array(rows[jet][2])
        for a in range(len(x)):
            order = sorted((((x[a, :2] - x[b, :2]) ** 2).sum(), b) for b in range(len(x)) if b != a)[:2]
            out = np.zeros(3)
            if order:
                messages = []
                for _, b in order:
                    h = np.concatenate([x[a], x[b] - x[a]]) @ w["c.edge.w"].value + w["c.edge.b"].value
                    messages.append(np.where(h > 0, h, 0.1 * h) @ w["c.out.w"].value + w["c.out.b"].value)
                out = np.max(messages, axis=0)
            assert np.allclose(got[j, a], out)


def test_masks_are_redrawn_by_salt_and_of_the_right_number():
    net = NETWORKS["masked"]
    (jets,) = numpy_jets(jet_rows((2, 3, 5, 4, 7, 2)))
    a, b = net.masked(jets, 1), net.masked(jets, 2)
    assert a.sum(1).tolist() == [round(n * 0.5) for n in jets.counts.tolist()] == b.sum(1).tolist()
    assert (a != b).any() and not (a & ~jets.valid).any()
    # A hidden token's features can't be seen, its place can.
    w, x = net.weights(net.initial(1)), jets.x.copy()
    jets.x[..., 2:][a] += 5.0
    out = [net._encoded(w, jets, a, 1, False).value]
    jets.x[...] = x
    out.append(net._encoded(w, jets, a, 1, False).value)
    assert np.allclose(*out)


def test_set_loss_is_the_least_over_orders_and_overfull_jets_raise():
    from itertools import permutations

    net = networks.ClassTokenAutoencoder(4, width=6, layers=1, latent=2, slots=4)
    rows = jet_rows((3, 2, 4))
    (jets,) = numpy_jets(rows)
    w = net.weights(net.initial(5) * 3)
    got = dict(zip(jets.ids.tolist(), net.scores(w, jets, 0).tolist()))
    context = net.context(w, jets, 0, False)
    slots = gradients.spread(w["slot.token"], (3, 4, 6)) + context
    out = networks.linear(w, "head", net.blocks(w, "decode", slots, np.ones((3, 4), bool), jets, 0, False)).value
    for j, jet in enumerate(jets.ids.tolist()):
        x = np.array(rows[jet][2])
        assert got[jet] == pytest.approx(min(((out[j, list(p)] - x) ** 2).mean() for p in permutations(range(4), len(x))))
    with pytest.raises(ValueError, match="5 particles for 4 slots"):
        net.scores(w, numpy_jets(jet_rows((5,)))[0], 0)


@pytest.fixture(scope="module")
def table(spark):
    rows = jet_rows(tuple(np.random.default_rng(2).integers(2, 8, 300).tolist()), 3)
    rows += [(300, 1, None), (301, 0, [[1.0] * 4]), (302, None, [[float("nan"), 1.0, None, 2.0], [1.0, float("inf"), 0.0, 0.5]]), (None, 1, [[1.0] * 4] * 2)]
    df = spark.createDataFrame(rows, "jet long, y int, v array<array<double>>").repartition(5)
    return training.jet_table(df, "jet", "y", "v")


def cleaned(table):
    return sorted(((r.id, r.label, r.x) for r in table.collect()), key=lambda r: r[0])


def test_jet_tables_and_standards(table):
    rows = cleaned(table)
    assert [r[0] for r in rows] == [*range(300), 302]
    assert rows[-1][1:] == (0, [[0.0, 1.0, 0.0, 2.0], [1.0, 0.0, 0.0, 0.5]])
    nodes = np.concatenate([np.array(r[2]) for r in rows])
    mean, std = training.standards(table, 4)
    assert np.allclose(mean, nodes.mean(0)) and np.allclose(std, nodes.std(0, ddof=1))
    mean, std = training.standards(table.where("false"), 4)
    assert mean.tolist() == [0.0] * 4 and std.tolist() == [1.0] * 4


@pytest.mark.parametrize("name", ["classifier", "class_set", "masked"])
def test_spread_gradients_equal_those_of_one_batch(spark, table, name, monkeypatch):
    monkeypatch.setattr(training, "CHUNK", 100)
    snapshot = training.start(NETWORKS[name], table, Plan())
    loss, weight, grad = training.gradient(table, snapshot, 77)
    (jets,) = numpy_jets(cleaned(table), snapshot.arrays["mean"], snapshot.arrays["std"], 10_000)
    w = snapshot.network.weights(snapshot.weights)
    values, n = snapshot.network.losses(w, jets, 77, True)
    total = (values * n).sum()
    total.backward()
    want = np.concatenate([(v.grad if v.grad is not None else np.zeros(v.shape)).ravel() for v in w.values()])
    assert loss == pytest.approx(float(total.value)) and weight == pytest.approx(n.sum()) and np.allclose(grad, want)
    assert training.mean_loss(table, snapshot, 77) == pytest.approx(float((snapshot.network.losses(w, jets, 77, False)[0].value * n).sum() / n.sum()))
    got = {r.id: r.score for r in training.scores(table, snapshot, 77).collect()}
    assert got == pytest.approx(dict(zip(jets.ids.tolist(), snapshot.network.scores(w, jets, 77).tolist())))
    z = {r.id: r.z for r in training.latents(table, snapshot).collect()}
    for i, v in zip(jets.ids.tolist(), snapshot.network.latents(w, jets).tolist()):
        assert z[i] == pytest.approx(v)
    assert training.gradient(table.where("false"), snapshot)[:2] == (0.0, 0.0) and math.isnan(training.mean_loss(table.where("false"), snapshot))


def test_the_optimiser_equals_a_plain_loop():
    """Decoupled decay: weights shrink by rate * decay, whatever the gradient's scale."""
    rng = np.random.default_rng(0)
    w = p = rng.normal(size=5)
    moments, m, v = Moments(np.zeros(5), np.zeros(5)), np.zeros(5), np.zeros(5)
    for t in range(1, 6):
        g = rng.normal(size=5)
        w = moments.step(w, g, 0.1, 0.01)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * 0.01 * p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(w, p)
    assert [Plan(schedule="step", rate=1.0, every=2, gamma=0.5).rate_of(e) for e in range(5)] == [1.0, 1.0, 0.5, 0.5, 0.25]
    cosine = Plan(schedule="cosine", rate=1.0, epochs=4, floor=0.0)
    assert [round(cosine.rate_of(e), 6) for e in range(5)] == [1.0, 0.853553, 0.5, 0.146447, 0.0]
    with pytest.raises(ValueError):
        Plan(schedule="other")


def test_training_learns_goes_on_and_keeps_last_and_best_apart(spark, table, tmp_path):
    net, plan = networks.GraphAutoencoder(4, width=5, smallest=2, k=2, wide=2), Plan(epochs=4, steps=2, rate=2e-2)
    train, val = training.dealt(table.where("id % 5 > 0"), plan, 2), table.where("id % 5 = 0")
    assert sorted(r.id for r in train.select("id").collect()) == sorted(r.id for r in table.where("id % 5 > 0").select("id").collect())
    whole = training.fit(net, train, val, plan)
    losses = [h["train_loss"] for h in whole.history]
    assert losses == sorted(losses, reverse=True) and [h["epoch"] for h in whole.history] == [0, 1, 2, 3]
    assert whole.best.about["epoch"] == 1 + int(np.argmin([h["val_loss"] for h in whole.history]))
    path = str(tmp_path / "model")
    training.fit_at(spark, path, net, train, val, plan, until=2)
    assert [v for v, _ in snapshots.versions(spark, path, "last")] == [1, 2]
    resumed = training.fit_at(spark, path, net, train, val, plan)
    assert np.allclose(resumed.last.weights, whole.last.weights) and resumed.history == [pytest.approx(h) for h in whole.history]
    assert snapshots.load(spark, path, "last").about["epoch"] == 4 and np.allclose(snapshots.load(spark, path, "best").weights, whole.best.weights)
    with pytest.raises(ValueError, match="another plan"):
        training.fit_at(spark, path, net, train, val, Plan(epochs=9))
    rows = {r.id: r.z for r in training.latent_table(table, path).collect()}
    assert rows == {r.id: pytest.approx(r.z) for r in training.latents(table, whole.best).collect()}
    again = training.latent_table(table.where("false"), path)  # read, not encoded anew
    assert again.count() == len(rows)
    assert training.history_table(spark, whole).count() == 4
    with pytest.raises(ValueError, match="no jets"):
        training.fit(net, train.where("false"), val, plan)


def test_snapshots_are_whole_or_unread_and_of_one_kind(spark, tmp_path):
    path, net = str(tmp_path / "m"), NETWORKS["classifier"]
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, path, "best")
    kept = snapshots.Snapshot(net, net.initial(1), {"mean": np.arange(4.0)}, {"epoch": 3})
    assert snapshots.save(spark, path, "best", kept) == 1
    got = snapshots.load(spark, path, "best", networks.EdgeConvClassifier)
    assert got.network == net and (got.weights == kept.weights).all() and got.arrays["mean"].tolist() == [0, 1, 2, 3] and got.about == {"epoch": 3} and got.version == 1
    with pytest.raises(TypeError, match="EdgeConvClassifier"):
        snapshots.load(spark, path, "best", networks.TokenAutoencoder)
    # A write that was stopped: nobody reads it, the next number is free.
    assert snapshots.save(spark, path, "best", snapshots.Snapshot(net, net.initial(2), {}, {})) == 2
    (tmp_path / "m" / "best" / "version=2" / "_SUCCESS").unlink()
    assert snapshots.load(spark, path, "best").version == 1 and snapshots.versions(spark, path, "best") == [(1, True), (2, False)]
    assert snapshots.save(spark, path, "best", kept) == 3 and snapshots.load(spark, path, "best").version == 3
    assert snapshots.load(spark, path, "best", version=1).version == 1
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, path, "last")
    with pytest.raises(ValueError):
        snapshots.save(spark, path, "other", kept)


class _Curves:
    """Trials whose values are known for every number of epochs."""

    def __init__(self, n, stop_after=None):
        self.epochs, self.n, self.stop_after = [], n, stop_after

    def __call__(self, trial, setting, epochs):
        if self.stop_after is not None and len(self.epochs) >= self.stop_after:
            raise RuntimeError("stopped")
        self.epochs.append((trial, epochs))
        return setting["height"] * (1 - 0.5**epochs) if setting["height"] is not None else float("nan")


def test_halving_finds_the_grids_winner_with_fewer_epochs_and_goes_on_after_a_stop(spark, tmp_path):
    grid = [{"height": h} for h in (0.3, 0.9, None, 0.5, 0.9, 0.1, 0.7, 0.2)]
    halving = sweeps.Halving(8, 1, 2)
    assert halving.rungs() == [1, 2, 4, 8] and sweeps.Halving(5, 2, 3).rungs() == [2, 5]
    curves = _Curves(8)
    rungs = sweeps.halving_sweep(spark, str(tmp_path / "a"), grid, curves, halving, at_once=3)
    best = sweeps.winner(rungs).first()
    assert (best.trial, best.epochs, json.loads(best.setting)) == (1, 8, {"height": 0.9})
    assert sorted((r.trial, r.rung) for r in rungs.collect()) == sorted([(t, 0) for t in range(8)] + [(t, 1) for t in (1, 3, 4, 6)] + [(1, 2), (4, 2), (1, 3)])
    assert len(curves.epochs) == 15 < 8 * 4
    # Stopped after five results: what is there isn't run again.
    with pytest.raises(RuntimeError):
        sweeps.halving_sweep(spark, str(tmp_path / "b"), grid, _Curves(8, stop_after=5), halving, at_once=1)
    rest = _Curves(8)
    again = sweeps.halving_sweep(spark, str(tmp_path / "b"), grid, rest, halving, at_once=1)
    assert len(rest.epochs) == 10 and sorted(map(repr, again.collect())) == sorted(map(repr, rungs.collect()))
    assert sweeps.winner(again).first().trial == 1
    with pytest.raises(ValueError, match="another sweep"):
        sweeps.halving_sweep(spark, str(tmp_path / "b"), grid[::-1], _Curves(8), halving)
    assert sweeps.promoted({0: float("nan"), 1: None, 2: 0.0}, 2) == [2]


def test_the_classifier_learns_what_summaries_cannot_tell(spark, data):
    """On the smallest tables: trained loss falls well below that of knowing the share of signal alone."""
    from quarkflow.plans import training_queries as q

    plan = Plan(epochs=12, steps=4, rate=3e-2)
    rows = q.jets(spark, data)
    train, val, test = q.sides(rows, plan)
    trained = training.fit(networks.EdgeConvClassifier(4, smallest=16, k=4, reduced_k=4), train, val, plan)
    assert trained.history[-1]["train_loss"] < 0.95 * trained.history[0]["train_loss"]
    assert train.count() + val.count() + test.count() == rows.count()


QUERIES = "edgeconv_classifier_auc graph_autoencoder_history graph_autoencoder_scores class_token_set_auc class_token_index_auc token_autoencoder_auc masked_transformer_auc trained_latents halved_sweep".split()


@pytest.mark.parametrize("name", QUERIES)
def test_registered_queries_run(spark, data, name, monkeypatch):
    """Each query as it is, but for shorter training."""
    from quarkflow.plans import queries as plans
    from quarkflow.plans import training_queries as q

    monkeypatch.setattr(q.training, "Plan", lambda **kw: Plan(**kw | {"steps": 1, "epochs": min(2, kw["epochs"]) if name != "halved_sweep" else kw["epochs"]}))
    df = plans.queries()[name](spark, data)
    rows = df.collect()
    assert rows and not any(isinstance(v, float) and v != v for r in rows for v in r)
    if "auc" in df.columns:
        assert all(0 <= r.auc <= 1 for r in rows)
    if name == "graph_autoencoder_history":
        assert [r.epoch for r in rows] == [0, 1] and rows[1].val_loss < rows[0].val_loss, rows
    if name == "halved_sweep":
        assert sorted((r.rung, r.epochs) for r in rows) == [(0, 1)] * 4 + [(1, 2)] * 2 + [(2, 4)]


@pytest.mark.parametrize("name", ["class_token_set_auc", "class_token_index_auc"])
def test_slots_grow_with_the_largest_jet(spark, data, name, monkeypatch):
    """A table with a jet of more particles than SLOTS is trained and scored whole."""
    from quarkflow.plans import queries as plans
    from quarkflow.plans import training_queries as q

    monkeypatch.setattr(q.training, "Plan", lambda **kw: Plan(**kw | {"steps": 1, "epochs": 1}))
    monkeypatch.setattr(q, "SLOTS", 4)
    rows = q.jets(spark, data)
    assert rows.where("size(x) > 4").count()
    (got,) = plans.queries()[name](spark, data).collect()
    assert got.n_pos == rows.where("label = 1").count() and got.n_neg > 0 and 0 <= got.auc <= 1


def test_matchings_of_a_stack_equal_single_ones():
    from quarkflow.operators.models import assignment, assignments

    rng = np.random.default_rng(5)
    cost, counts = rng.normal(size=(200, 6, 8)) ** 2, rng.integers(0, 7, 200)
    cost[:50] = rng.integers(0, 3, (50, 6, 8))  # equal costs
    got = assignments(cost, counts)
    for c, n, columns in zip(cost, counts.tolist(), got.tolist()):
        assert columns[n:] == [-1] * (6 - n) and len(set(columns[:n])) == n
        rows, want = assignment(c[:n]) if n else ([], [])
        assert sum(c[i, j] for i, j in enumerate(columns[:n])) == pytest.approx(c[rows, want].sum() if n else 0)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 1e308])
def test_matchings_end_whatever_the_costs(bad):
    """Costs that are no numbers or overflow count as the largest; they once sent the search in circles, so it has a clock here."""
    import signal

    from quarkflow.operators.models import assignment, assignments

    cost = np.array([[[bad, 2.0, 1.0], [bad, 1.0, 3.0]], [[bad] * 3] * 2])
    signal.signal(signal.SIGALRM, lambda *_: pytest.fail("the matching doesn't end"))
    signal.alarm(10)
    try:
        got = assignments(cost, np.array([2, 2]))
        rows, columns = assignment(cost[1])
    finally:
        signal.alarm(0)
    assert got[0].tolist() == [2, 1] and len(set(got[1].tolist())) == 2 == len(set(columns.tolist())) and sorted(rows.tolist()) == [0, 1]


@pytest.mark.parametrize(("features", "inner", "slope"), [(3, 7, 0.1), (7, 3, 0.0)])
def test_edge_layers_applied_by_node_equal_layers_by_edge(features, inner, slope):
    """Value and every gradient against the composition of plain operations, edges and nodes that are not there among them."""
    rng, g = np.random.default_rng(6), gradients
    (jets,) = numpy_jets(jet_rows((5, 1, 3, 2, 6)))
    at, there = networks.nearest(jets.place, jets.valid, 3)
    start = [rng.normal(size=s) for s in ((*jets.valid.shape, features), (2 * features, inner), (inner,), (inner, 4), (4,))]
    out = rng.normal(size=(*jets.valid.shape, 4))
    x, w1, b1, w2, b2 = (g.Node(v) for v in start)
    centre = g.spread(x.reshape(x.shape[0], x.shape[1], 1, features), (*at.shape, features))
    message = g.leaky(g.joined([centre, g.gathered(x, at) - centre], 3) @ w1 + b1, slope) @ w2 + b2
    want = g.largest(message, there[..., None], 2)
    want.backward(out)
    mine = [g.Node(v) for v in start]
    got = g.edge_largest(mine[0], (mine[1], mine[2]), (mine[3], mine[4]), at, there, g.incoming(at), slope)
    got.backward(out)
    assert np.allclose(got.value, want.value)
    for a, b in zip(mine, (x, w1, b1, w2, b2)):
        assert np.allclose(a.grad, b.grad)


def test_scores_are_made_once_for_a_curve(spark):
    """A network behind the scores runs once a row, however often cells and sums read them."""
    from pyspark.sql import functions as F

    from quarkflow.operators.metrics import roc_auc

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        calls.add(1)
        return float(i * 7 % 1000)

    rows = spark.range(1000).select(score.asNondeterministic()("id").alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    assert roc_auc(rows).first().n_pos == 500
    assert calls.value == 1000


@pytest.mark.parametrize("k", [2, 4, 8])
def test_stacks_of_one_size_give_what_gathered_edges_give(k, monkeypatch):
    """Loss and gradient of the classifier by all pairs against the edges one by one: fewer, as many and more neighbours than k, equal distances among them."""
    rng, net = np.random.default_rng(8), networks.EdgeConvClassifier(4, smallest=3, k=k, reduced_k=k)
    flat = net.initial(3) + 0.05 * rng.normal(size=net.size())
    for n in (2, 3, 5, 6, 7):
        rows = jet_rows((n,) * 70, n)
        for _, _, x in rows:
            for node in x:
                node[:2] = rng.integers(0, 3, 2).tolist()
        (jets,) = numpy_jets(rows)
        near = gradients.pairs_near(jets.place.transpose(1, 0, 2), k)
        at, there = networks.nearest(jets.place, jets.valid, k)
        assert (near is None) == (n - 1 <= k)
        if near is not None:
            r, a, jet = np.nonzero(near)
            assert sorted(zip(jet, a, (a + r + 1) % n)) == sorted((j, a, b) for j in range(70) for a in range(n) for b in at[j, a])
        got = []
        for stacked in (networks.STACKED, 0):
            monkeypatch.setattr(networks, "STACKED", stacked)
            w = net.weights(flat)
            values, weight = net.losses(w, jets, 0, True)
            (values * weight).sum().backward()
            got.append(np.concatenate([values.value.ravel(), *(v.grad.ravel() for v in w.values())]))
        monkeypatch.undo()
        assert np.allclose(*got, rtol=1e-10, atol=1e-11)


@pytest.mark.parametrize("slope", [0.0, 0.1])
def test_all_pairs_equal_edges_of_the_nearest(slope):
    rng, g = np.random.default_rng(6), gradients
    (jets,) = numpy_jets(jet_rows((6,) * 5))
    start = [rng.normal(size=s) for s in ((8, 7), (7,), (7, 3), (3,))]
    at, there = networks.nearest(jets.place, jets.valid, 3)
    x, *layers = (g.Node(v) for v in (jets.x, *start))
    want = g.edge_largest(x, tuple(layers[:2]), tuple(layers[2:]), at, there, g.incoming(at), slope)
    y, *mine = (g.Node(v) for v in (jets.x.transpose(1, 0, 2), *start))
    got = g.pair_largest(y, tuple(mine[:2]), tuple(mine[2:]), g.pairs_near(jets.place.transpose(1, 0, 2), 3), slope)
    out = rng.normal(size=want.shape)
    want.backward(out)
    got.backward(out.transpose(1, 0, 2))
    assert np.allclose(got.value.transpose(1, 0, 2), want.value) and np.allclose(y.grad.transpose(1, 0, 2), x.grad)
    for a, b in zip(mine, layers):
        assert np.allclose(a.grad, b.grad)


def test_sizes_of_many_jets_are_looked_at_alone():
    rows = jet_rows((3,) * 70 + (4,) * 65 + (5, 9, 6))
    jets = numpy_jets(rows)
    assert [(len(j.ids), j.valid.shape[1]) for j in jets] == [(70, 3), (65, 4), (3, 9)]
    assert [i for j in jets for i in j.ids.tolist()] == [*range(135), 135, 137, 136]
    for j in jets:
        for i, n, x in zip(j.ids.tolist(), j.counts.tolist(), j.x):
            assert x[:n].tolist() == rows[i][2]


@pytest.mark.parametrize("ids", [[5, 9, 7], list(range(0, 230, 2)), [i * i % 10_007 for i in range(1, 5001)], [1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 9], [1, 2], [1, 2, 3, 4, None]])
def test_sides_by_borders_are_those_of_ranks(spark, ids, monkeypatch):
    """Two ids part the sides as ranks do; where they can't (equal ids, missing ones, too few rows), ranks do it."""
    from quarkflow.operators import splits
    from quarkflow.plans import training_queries as q

    rows = spark.createDataFrame([(i, i, 0, [[1.0] * 4] * 2) for i in ids], "id long, key long, label int, x array<array<double>>").repartition(3)
    borders = splits.three_way_borders(rows, "id")
    assert (borders is None) == (len(set(ids)) < len(ids) or len(ids) < 3 or None in ids)
    if borders:
        want = {name: sorted(r.id for r in splits.three_way_split(rows, "id").where(f"split = '{name}'").collect()) for name in ("train", "val", "test")}
        monkeypatch.setattr(q.splits, "three_way_split", None)
        got = q.sides(rows, Plan(steps=2))
        assert [sorted(r.id for r in side.select("id").collect()) for side in got] == list(want.values())


def test_softmax_norm_and_gelu_by_their_definitions():
    """Values and gradients, all places allowed and not, large numbers among them; short sums are products with ones."""
    rng, g = np.random.default_rng(9), gradients
    v, out = rng.normal(size=(3, 2, 5)) * 4, rng.normal(size=(3, 2, 5))
    v[0, 0] += 800
    some = rng.random(v.shape) < 0.6
    some[1, 1] = False

    def soft(x, allowed):
        with np.errstate(invalid="ignore"):
            e = np.where(allowed, np.exp(x - x.max(-1, keepdims=True)), 0)
        return e / np.where(e.sum(-1, keepdims=True) > 0, e.sum(-1, keepdims=True), 1)

    def normed(x):
        return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)

    def smooth(x):
        return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))

    assert g.row_sums(v).shape == (3, 2, 1) and np.allclose(g.row_sums(v), v.sum(-1, keepdims=True))
    for at, mine, want in ((v, lambda x: g.softmax(x, np.ones(x.shape, bool)), lambda x: soft(x, True)), (v, lambda x: g.softmax(x, some), lambda x: soft(x, some)), (v - v.mean(-1, keepdims=True), g.layer_norm, normed), (v[1:], g.gelu, smooth)):
        x, o = g.Node(at), out[-len(at) :]
        y = mine(x)
        y.backward(o)
        assert np.allclose(y.value, want(at))
        for i in np.ndindex(at.shape):
            e = np.zeros(at.shape)
            e[i] = 1e-6
            assert x.grad[i] == pytest.approx(((want(at + e) - want(at - e)) * o).sum() / 2e-6, abs=1e-5)
