"""Training of networks by data-parallel gradient steps, and scores, latents and losses from trained weights.

A table of jets (id, label, x: lists of feature lists) is written once, dealt into one folder per step of an epoch. A
step broadcasts the weights (bounded by the network), every task sums the gradients of its share of the step's jets,
batch by batch, and the tasks' sums are added up on executors in chunks of CHUNK numbers, in the order of the tasks; the
driver gets one vector of the network's size and takes the optimiser's step. No jets reach the driver.

Defined results: jets with fewer than `least` nodes or without an id are left out; missing and non-finite features count
as 0, a NULL label as 0. A table without jets is an error of `fit`, and gives no scores. Results don't depend on where a jet
is processed but for the rounding of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.functions.expr import zero_unless_finite
from quarkflow.operators.networks import Jets, Network, jets_of
from quarkflow.sources.shared import written
from quarkflow.sources.sinks import is_complete
from quarkflow.sources.snapshots import Snapshot, load, save, versions

#: Numbers of a gradient that are added up in one group, and jets that a task looks at together at most (fewer of many nodes: networks.PAIRS).
CHUNK, TOGETHER = 8192, 256


@dataclass(frozen=True)
class Plan:
    """How to train. steps: gradient steps an epoch, each over its own share of the jets. schedule: constant, step (rate * gamma after every `every` epochs) or cosine (down to `floor` over all epochs)."""

    epochs: int = 10
    steps: int = 4
    rate: float = 1e-2
    decay: float = 1e-4
    schedule: str = "step"
    every: int = 10
    gamma: float = 0.7
    floor: float = 1e-6
    seed: int = 42

    def __post_init__(self) -> None:
        if self.schedule not in ("constant", "step", "cosine") or self.epochs < 1 or self.steps < 1:
            raise ValueError("a plan needs epochs, steps and one of the schedules")

    def rate_of(self, epoch: int) -> float:
        if self.schedule == "step":
            return self.rate * self.gamma ** (epoch // self.every)
        if self.schedule == "cosine":
            return self.floor + (self.rate - self.floor) * (1 + math.cos(math.pi * epoch / self.epochs)) / 2
        return self.rate


@dataclass
class Moments:
    """State of the optimiser between steps: running means of gradients and of their squares. The decay acts on weights, not through the gradient."""

    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, weights: np.ndarray, grad: np.ndarray, rate: float, decay: float) -> np.ndarray:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad * grad
        mean, square = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.999**self.steps)
        return weights * (1 - rate * decay) - rate * mean / (np.sqrt(square) + 1e-8)


@dataclass
class Trained:
    """last and best (by validation loss) snapshots, and a row per epoch: epoch, rate, train_loss, val_loss."""

    last: Snapshot
    best: Snapshot
    history: list[dict] = field(default_factory=list)


def jet_table(df: DataFrame, id_col: str, label: Column | str, vectors: str, least: int = 2) -> DataFrame:
    """(id, key, label, x) of the jets that have at least `least` nodes. vectors: a column of lists of feature lists."""
    label = F.col(label) if isinstance(label, str) else label
    x = F.transform(vectors, lambda v: F.transform(v, lambda c: zero_unless_finite(c.cast("double"))))
    rows = df.where((F.size(vectors) >= least) & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).cast("long").alias("key"), F.coalesce(label.cast("int"), F.lit(0)).alias("label"), x.alias("x"))


def standards(jets: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, sample deviations) of each feature over all nodes; a constant feature has deviation 1."""
    nodes = jets.select(F.explode("x").alias("v"))
    v = [F.get("v", F.lit(i)) for i in range(features)]
    row = nodes.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(v)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(v))).first()
    mean, std = (np.array([row[f"{n}{i}"] or 0.0 for i in range(features)]) for n in "ms")
    return mean, np.where((std > 0) & np.isfinite(std), std, 1.0)


def _over_jets(df: DataFrame, snapshot: Snapshot, work: Callable[[dict, Jets], pa.RecordBatch], schema: str) -> DataFrame:
    """work(weights, jets) for all jets of df, batch by batch."""
    shared = df.sparkSession.sparkContext.broadcast((snapshot.network, snapshot.weights, snapshot.arrays["mean"], snapshot.arrays["std"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, flat, mean, std = shared.value
        for batch in batches:
            for jets in jets_of(batch, mean, std, TOGETHER, network.least()):
                yield work(network.weights(flat), jets)

    return df.select("id", "key", "label", "x").mapInArrow(run, schema)


def scores(df: DataFrame, snapshot: Snapshot, salt: int = 0) -> DataFrame:
    """(id, label, score) of every jet: the network's score, from its own whole set of nodes."""
    network = snapshot.network

    def work(w: dict, jets: Jets) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(jets.ids), pa.array(jets.labels.astype(np.int32)), pa.array(network.scores(w, jets, salt))], names=["id", "label", "score"])

    return _over_jets(df, snapshot, work, "id long, label int, score double")


def latents(df: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(id, label, z) of every jet: the class token's latent numbers, or the mean of its nodes'."""
    network = snapshot.network

    def work(w: dict, jets: Jets) -> pa.RecordBatch:
        z = network.latents(w, jets)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(jets.ids), pa.array(jets.labels.astype(np.int32)), lists], names=["id", "label", "z"])

    return _over_jets(df, snapshot, work, "id long, label int, z array<double>")


def mean_loss(df: DataFrame, snapshot: Snapshot, salt: int = 0) -> float:
    """The network's loss over all jets; NaN without any."""
    network = snapshot.network

    def work(w: dict, jets: Jets) -> pa.RecordBatch:
        values, weight = network.losses(w, jets, salt, False)
        return pa.RecordBatch.from_arrays([pa.array([float((values.value * weight).sum())]), pa.array([float(weight.sum())])], names=["loss", "weight"])

    row = _over_jets(df, snapshot, work, "loss double, weight double").agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight")).first()
    return row["loss"] / row["weight"] if row["weight"] else math.nan


def gradient(df: DataFrame, snapshot: Snapshot, salt: int = 0, training: bool = True) -> tuple[float, float, np.ndarray]:
    """(loss, weight, gradient) summed over all jets of df."""
    spark, network = df.sparkSession, snapshot.network
    shared = spark.sparkContext.broadcast((snapshot.weights, snapshot.arrays["mean"], snapshot.arrays["std"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, mean, std = shared.value
        total = np.zeros(len(flat) + 2)
        for batch in batches:
            for jets in jets_of(batch, mean, std, TOGETHER, network.least()):
                w = network.weights(flat)
                values, weight = network.losses(w, jets, salt, training)
                loss = (values * weight).sum()
                loss.backward()
                total[:2] += float(loss.value), float(weight.sum())
                total[2:] += np.concatenate([(n.grad if n.grad is not None else np.zeros(n.shape)).ravel() for n in w.values()])
        chunks = [total[at : at + CHUNK] for at in range(0, len(total), CHUNK)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chunks), part, np.int32)), pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array([c.tobytes() for c in chunks], pa.binary())], names=["part", "chunk", "v"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum([np.frombuffer(v, float) for v in table.column("v").to_pylist()], axis=0)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    sums = df.select("id", "key", "label", "x").mapInArrow(run, "part int, chunk int, v binary").groupBy("chunk").applyInArrow(add, "chunk int, v binary")
    rows = sorted(sums.collect(), key=lambda r: r["chunk"])  # one vector of the network's size
    shared.destroy()
    if not rows:
        return 0.0, 0.0, np.zeros(network.size())
    total = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), float)
    return float(total[0]), float(total[1]), total[2:]


def dealt(train: DataFrame, plan: Plan, parts: int | None = None) -> DataFrame:
    """train, written with its jets dealt at random into plan.steps folders (`step`), each read alone by its step; parts: tasks of a step, at most a shuffle's partitions and no more than have some batches each."""
    most = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(1, min(most, train.count() // (plan.steps * 2 * TOGETHER)))
    step = F.pmod(F.xxhash64("id", F.lit(plan.seed)), F.lit(plan.steps)).cast("int")
    return written(train.withColumn("step", step).repartition(parts, F.xxhash64("id", F.lit(plan.seed + 1))), "train", "step")


def start(network: Network, train: DataFrame, plan: Plan) -> Snapshot:
    """An untrained snapshot: starting weights, the features' standards over train, moments at rest."""
    mean, std = standards(train, network.features)
    zero = np.zeros(network.size())
    return Snapshot(network, network.initial(plan.seed), {"mean": mean, "std": std, "first": zero, "second": zero}, {"epoch": 0, "steps": 0, "val_loss": None, "plan": asdict(plan)})


def fit(network: Network, train: DataFrame, val: DataFrame, plan: Plan, resume: Trained | None = None, until: int | None = None, after_epoch: Callable[[Snapshot, bool], None] | None = None) -> Trained:
    """Train to plan.epochs (or `until`), from the start or on from what an earlier call with this plan gave: the result is the same.

    train: from dealt(). after_epoch(snapshot, whether it is the best so far) may save it.
    """
    last = resume.last if resume else start(network, train, plan)
    if type(last.network) is not type(network) or last.network != network:
        raise TypeError("the snapshot is of another network")
    best, history = resume.best if resume else last, list(resume.history) if resume else []
    moments = Moments(last.arrays["first"], last.arrays["second"], last.about["steps"])
    for epoch in range(last.about["epoch"], until or plan.epochs):
        loss = weight = 0.0
        order = np.random.default_rng([plan.seed, epoch]).permutation(plan.steps).tolist()
        for step in order:
            salt = (plan.seed * 1_000_003 + epoch) * 4096 + step
            one, n, grad = gradient(train.where(F.col("step") == step), last, salt)
            if n:
                last = Snapshot(network, moments.step(last.weights, grad / n, plan.rate_of(epoch), plan.decay), last.arrays, last.about)
            loss, weight = loss + one, weight + n
        if not weight:
            raise ValueError("no jets to train on")
        last = Snapshot(network, last.weights, last.arrays | {"first": moments.first, "second": moments.second}, last.about | {"epoch": epoch + 1, "steps": moments.steps})
        val_loss = mean_loss(val, last, salt=plan.seed)
        least = last.about["val_loss"]
        is_best = val_loss == val_loss and (least is None or val_loss < least)
        last.about["val_loss"] = val_loss if is_best else least
        best = last if is_best or best.about["epoch"] == 0 else best
        history.append({"epoch": epoch, "rate": plan.rate_of(epoch), "train_loss": loss / weight, "val_loss": val_loss})
        last.about["history"] = list(history)
        if after_epoch:
            after_epoch(last, is_best)
    return Trained(last, best, history)


def history_table(spark: SparkSession, trained: Trained) -> DataFrame:
    return spark.createDataFrame([(h["epoch"], h["rate"], h["train_loss"], h["val_loss"]) for h in trained.history], "epoch int, rate double, train_loss double, val_loss double")


def fit_at(spark: SparkSession, path: str, network: Network, train: DataFrame, val: DataFrame, plan: Plan, until: int | None = None) -> Trained:
    """fit() whose snapshots are kept in path: goes on from the last one there, publishes every epoch's and each best one."""
    resume = None
    if any(done for _, done in versions(spark, path, "last")):
        last = load(spark, path, "last", type(network))
        if last.about["plan"] != asdict(plan):
            raise ValueError(f"{path} was trained by another plan")
        best = load(spark, path, "best", type(network)) if any(done for _, done in versions(spark, path, "best")) else last
        resume = Trained(last, best, last.about.get("history", []))

    def keep(snapshot: Snapshot, is_best: bool) -> None:
        for tag in ("last", *["best"] * is_best):
            snapshot.version = save(spark, path, tag, snapshot)

    return fit(network, train, val, plan, resume, until, keep)


def latent_table(df: DataFrame, path: str, tag: str = "best") -> DataFrame:
    """latents() of the newest snapshot in path, encoded once: kept beside it under its version, and read from there afterwards.

    The table belongs to one table of jets; a folder per table is the caller's to choose.
    """
    spark = df.sparkSession
    snapshot = load(spark, path, tag)
    folder = f"{path.rstrip('/')}/latents/{tag}-{snapshot.version}"
    if not is_complete(spark, folder):
        latents(df, snapshot).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
