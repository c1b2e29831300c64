"""Scores from models: linear and neural, without a deep-learning library.

Linear parts are Spark's own (PCA, logistic regression). Graph and token networks run forward in NumPy over Arrow
batches of whole groups; small networks train on a bounded sample on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import d


# --- linear models ------------------------------------------------------------------------------------------------


def centred(df: DataFrame, features: list[str], of: DataFrame | None = None) -> tuple[DataFrame, dict[str, float]]:
    """df with the means (of another table, if given) taken off; the means."""
    means = (df if of is None else of).agg(*(F.avg(f).alias(f) for f in features)).first().asDict()
    means = {f: means[f] or 0.0 for f in features}
    return df.withColumns({f: F.col(f) - d(means[f]) for f in features}), means


def pca(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """df with `pc` (k coordinates of the centred features) and the explained variance ratios. Fewer than k features is an error."""
    if len(features) < k:
        raise ValueError(f"{k} components need {k} features")
    rows, _ = centred(df, features)
    if len(features) == k:
        return df.withColumn("pc", F.array(*features)), [1.0 / k] * k
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(rows)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)
    return model.transform(vectors).withColumn("pc", vector_to_array("_pc")).select(*df.columns, "pc"), model.explainedVariance.toArray().tolist()


def linear_reconstruction(df: DataFrame, train: DataFrame, features: list[str], k: int) -> DataFrame:
    """df with score: mean squared error of the best linear encoding to k numbers that train allows."""
    rows, _ = centred(train, features)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(VectorAssembler(inputCols=features, outputCol="_v").transform(rows))
    axes = model.pc.toArray()
    off, _ = centred(df, features, train)
    codes = [sum((d(axes[i, c]) * F.col(f) for i, f in enumerate(features)), d(0.0)) for c in range(k)]
    off = off.withColumns({f"_c{c}": x for c, x in enumerate(codes)})
    errors = [F.col(f) - sum((d(axes[i, c]) * F.col(f"_c{c}") for c in range(k)), d(0.0)) for i, f in enumerate(features)]
    return off.withColumn("score", sum((e * e for e in errors), d(0.0)) / len(features)).select(*(c for c in df.columns if c not in features), "score")


def logistic_scores(df: DataFrame, train: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """df with score: the probability of label 1 by logistic regression on train; rows with a missing feature are dropped."""
    assembler = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
    model = LogisticRegression(featuresCol="_v", labelCol=label, maxIter=50, regParam=1e-4).fit(assembler.transform(train))
    scored = model.transform(assembler.transform(df))
    return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "score")


# --- assignment ---------------------------------------------------------------------------------------------------


#: The largest cost of a pair in a matching; what is larger or no number counts as this, so that paths end and sums stay finite.
MOST = 1e100


def bounded(cost: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(cost, nan=MOST), -MOST, MOST)


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a least-cost one-to-one matching of the smaller side: shortest augmenting paths with potentials."""
    cost = bounded(cost)
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, done, back = np.full(m, np.inf), np.zeros(m, bool), np.full(m, -1)
        i, reached, at = row, 0.0, -1
        while True:
            reduced = reached + c[i] - u[i] - v
            better = ~done & (reduced < dist)
            dist[better], back[better] = reduced[better], at
            j = int(np.argmin(np.where(done, np.inf, dist)))
            reached = dist[j]
            done[j] = True
            if match[j] < 0:
                break
            i, at = match[j], j
        tree = done & (match >= 0)
        u[row] += reached
        u[match[tree]] += reached - dist[tree]
        v[done] -= reached - dist[done]
        while j >= 0:
            previous = back[j]
            match[j] = match[previous] if previous >= 0 else row
            j = previous
    columns = np.flatnonzero(match >= 0)
    rows = match[columns]
    return (columns, rows) if flip else (rows, columns)


def assignments(cost: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(matrices, rows) the column of each row in the least-cost matching of every matrix of a stack, which has no more rows than columns; -1 for rows beyond a matrix's count. As assignment(), all matrices at once."""
    cost = bounded(cost)
    size, n, m = cost.shape
    u, v, match, out = np.zeros((size, n)), np.zeros((size, m)), np.full((size, m), -1), np.full((size, n), -1)
    for row in range(n):
        live = np.flatnonzero(counts > row)
        c, uu, vv, mm = cost[live], u[live], v[live], match[live]
        dist, done, back = np.full(vv.shape, np.inf), np.zeros(vv.shape, bool), np.full(vv.shape, -1)
        i, at, j, reached = np.full(len(live), row), np.full(len(live), -1), np.zeros(len(live), int), np.zeros(len(live))
        going = np.arange(len(live))
        while len(going):
            reduced = reached[going, None] + c[going, i[going]] - uu[going, i[going]][:, None] - vv[going]
            better = ~done[going] & (reduced < dist[going])
            dist[going] = np.where(better, reduced, dist[going])
            back[going] = np.where(better, at[going, None], back[going])
            nearest = np.argmin(np.where(done[going], np.inf, dist[going]), axis=1)
            j[going], reached[going], done[going, nearest] = nearest, dist[going, nearest], True
            taken = mm[going, nearest]
            going, nearest, taken = going[taken >= 0], nearest[taken >= 0], taken[taken >= 0]
            i[going], at[going] = taken, nearest
        jet, column = np.nonzero(done & (mm >= 0))
        uu[:, row] += reached
        uu[jet, mm[jet, column]] += reached[jet] - dist[jet, column]
        vv = np.where(done, vv - (reached[:, None] - dist), vv)
        going = np.arange(len(live))
        while len(going):
            previous = back[going, j[going]]
            mm[going, j[going]] = np.where(previous >= 0, mm[going, previous], row)
            j[going] = previous
            going = going[previous >= 0]
        u[live], v[live], match[live] = uu, vv, mm
    jet, column = np.nonzero(match >= 0)
    out[jet, match[jet, column]] = column
    return out


def set_loss(rows: DataFrame, key: str, target: str, output: str) -> DataFrame:
    """(key, loss): per key, the mean squared distance of its target vectors (array column) to its outputs under the best matching. Rows whose output or target is NULL bring only the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            loss = []
            for targets, outputs in zip(pdf["_t"], pdf["_o"]):
                t, o = (np.array([list(v) for v in x], float) for x in (targets, outputs))
                cost = ((t[:, None, :] - o[None, :, :]) ** 2).mean(axis=2) if len(t) and len(o) else np.zeros((0, 0))
                loss.append(float(cost[assignment(cost)].mean()) if cost.size else 0.0)
            yield pdf[[key]].assign(loss=loss)

    sets = rows.groupBy(key).agg(F.collect_list(target).alias("_t"), F.collect_list(output).alias("_o"))
    return sets.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, loss double")


# --- networks -----------------------------------------------------------------------------------------------------


def dense(rng: np.random.Generator, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    return rng.uniform(-1, 1, (n, m)) / np.sqrt(n), np.zeros(m)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """k nearest others of every row of x, or of each of a stack (clamped to the rows there are), by distance, then number."""
    n = x.shape[-2]
    gap = ((x[..., :, None, :] - x[..., None, :, :]) ** 2).sum(-1)
    gap[..., np.arange(n), np.arange(n)] = np.inf
    return np.argsort(gap, axis=-1, kind="stable")[..., : max(1, min(k, n - 1))]


@dataclass
class EdgeConvEncoder:
    """Embedding, pre-norm residual edge convolutions down to `smallest`, and a mirrored decoder; weights from a seed or given."""

    features: int
    width: int = 32
    smallest: int = 4
    k: int = 3
    seed: int = 42
    weights: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        sizes = [self.width]
        while sizes[-1] > self.smallest:
            sizes.append(max(self.smallest, sizes[-1] // 2))
        self.down, self.up = list(zip(sizes, sizes[1:])), list(zip(sizes[::-1], sizes[::-1][1:]))
        self.weights.setdefault("embed", dense(rng, self.features, self.width))
        for side in ("down", "up"):
            for i, (a, b) in enumerate(getattr(self, side)):
                self.weights.setdefault(f"{side}{i}", dense(rng, 2 * a, b))
                self.weights.setdefault(f"{side}{i}skip", dense(rng, a, b))
        self.weights.setdefault("unembed", dense(rng, self.width, self.features))

    def conv(self, name: str, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Largest message over a node's edges, plus a projected skip. x and near may be stacks of groups of one size."""
        h = layer_norm(x)
        there = np.take_along_axis(h, near.reshape(*near.shape[:-2], -1)[..., None], axis=-2).reshape(*near.shape, -1)
        pairs = np.concatenate([np.broadcast_to(h[..., None, :], there.shape), there - h[..., None, :]], axis=-1)
        w, b = self.weights[name]
        s, c = self.weights[f"{name}skip"]
        return relu(pairs @ w + b).max(axis=-2) + x @ s + c

    def encode(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        w, b = self.weights["embed"]
        h = x @ w + b
        for i in range(len(self.down)):
            h = self.conv(f"down{i}", h, near)
        return h

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        near = neighbours(x[..., :2], self.k)
        h = self.encode(x, near)
        for i in range(len(self.up)):
            h = self.conv(f"up{i}", h, near)
        w, b = self.weights["unembed"]
        return h @ w + b


@dataclass
class TokenEncoder:
    """One pre-norm attention block over a set of tokens with a class token; `latent` is the class token's output."""

    features: int
    width: int = 16
    heads: int = 2
    seed: int = 42

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.w = {n: dense(rng, a, b) for n, a, b in (("embed", self.features, self.width), ("place", 2, self.width), ("q", self.width, self.width), ("k", self.width, self.width), ("v", self.width, self.width), ("o", self.width, self.width), ("up", self.width, 2 * self.width), ("down", 2 * self.width, self.width), ("out", self.width, self.features))}
        self.cls, self.mask = rng.normal(0, 0.02, self.width), rng.normal(0, 0.02, self.width)

    def _lin(self, name: str, x: np.ndarray) -> np.ndarray:
        w, b = self.w[name]
        return x @ w + b

    def forward(self, x: np.ndarray, masked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(outputs per token, latent). Masked tokens show their place (first two features) only. x and masked may be stacks of sets of one size."""
        h = self._lin("embed", x)
        if masked is not None:
            h = np.where(masked[..., None], self.mask, h)
        h = np.concatenate([np.broadcast_to(self.cls, (*h.shape[:-2], 1, self.width)), h + self._lin("place", x[..., :2])], axis=-2)
        a = layer_norm(h)
        split = lambda t: np.swapaxes(t.reshape(*t.shape[:-1], self.heads, -1), -2, -3)
        q, k, v = (split(self._lin(n, a)) for n in "qkv")
        s = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
        s = np.exp(s - s.max(-1, keepdims=True))
        h = h + self._lin("o", np.swapaxes(s / s.sum(-1, keepdims=True) @ v, -2, -3).reshape(h.shape))
        h = h + self._lin("down", relu(self._lin("up", layer_norm(h))))
        return self._lin("out", h[..., 1:, :]), h[..., 0, :]


def stacks(batch: pa.RecordBatch, vectors: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as one array) for each size of group in the batch, read from the lists' buffers."""
    lists = batch.column(vectors)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    nodes = lists.flatten()
    flat = nodes.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(nodes), -1)
    first = np.cumsum(n) - n
    for size in np.unique(n).tolist():
        rows = np.flatnonzero(n == size)
        yield rows, flat[first[rows][:, None] + np.arange(size)]


def group_scores(df: DataFrame, key: str, vectors: str, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, score) per row of df, whose vectors column is an array of feature arrays; score sees a stack of groups of one size. Rows of fewer than two vectors are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for rows, x in stacks(batch, vectors):
                for at in range(0, len(rows), 256):
                    out[rows[at : at + 256]] = score(x[at : at + 256])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out)], names=[key, "score"])

    return df.where(F.size(vectors) >= 2).select(key, vectors).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, score double")


def reconstruction_scores(df: DataFrame, key: str, vectors: str, model: EdgeConvEncoder) -> DataFrame:
    """Mean squared reconstruction error of every group."""
    return group_scores(df, key, vectors, lambda x: ((model.reconstruct(x) - x) ** 2).mean(axis=(1, 2)))


# --- training -----------------------------------------------------------------------------------------------------


@dataclass
class Mlp:
    """A small regression network with its training loop: AdamW, a stepped rate, the weights of the best validation loss."""

    sizes: tuple[int, ...]
    seed: int = 42
    layers: list[list[np.ndarray]] = field(default_factory=list)
    history: list[dict[str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.layers = self.layers or [list(dense(rng, a, b)) for a, b in zip(self.sizes, self.sizes[1:])]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else relu(z))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, val: tuple[np.ndarray, np.ndarray], epochs: int = 20, batch: int = 64, lr: float = 1e-2, decay: float = 1e-4, step: int = 10, gamma: float = 0.7, keep_best: bool = True) -> Mlp:
        rng = np.random.default_rng(self.seed)
        flat = [p for layer in self.layers for p in layer]
        m, s, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
        best, kept = np.inf, [p.copy() for p in flat]
        for epoch in range(epochs):
            rate = lr * gamma ** (epoch // step)
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                out = self.forward(x[rows])
                g = 2 * (out[-1] - y[rows]) / y[rows].size
                grads: list[np.ndarray] = []
                for i in range(len(self.layers) - 1, -1, -1):
                    grads = [out[i].T @ g, g.sum(0), *grads]
                    if i:
                        g = (g @ self.layers[i][0].T) * (out[i] > 0)
                t += 1
                for p, dp, mi, si in zip(flat, grads, m, s):
                    mi *= 0.9
                    mi += 0.1 * dp
                    si *= 0.999
                    si += 0.001 * dp * dp
                    p -= rate * (mi / (1 - 0.9**t) / (np.sqrt(si / (1 - 0.999**t)) + 1e-8) + decay * p)
            losses = {"epoch": epoch, "train_loss": float(((self.predict(x) - y) ** 2).mean()), "val_loss": float(((self.predict(val[0]) - val[1]) ** 2).mean())}
            self.history.append(losses)
            if losses["val_loss"] < best:
                best, kept = losses["val_loss"], [p.copy() for p in flat]
        if keep_best:
            for p, q in zip(flat, kept):
                p[...] = q
        return self


def bounded_sample(df: DataFrame, columns: list[str], limit: int, *ids: str, seed: int = 42) -> np.ndarray:
    """At most `limit` rows of columns on the driver, drawn by a hash of the ids."""
    rows = df.dropna(subset=columns).orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).limit(limit).select(*columns).collect()
    return np.array([list(r) for r in rows], float).reshape(-1, len(columns))


def network_scores(df: DataFrame, features: list[str], targets: list[str], model: Mlp, *keep: Column) -> DataFrame:
    """keep and score: the squared error of the targets predicted from the features, per row."""
    rows = df.select(*keep, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), *(F.col(f).cast("double").alias(f"_y{i}") for i, f in enumerate(targets)))
    names = rows.columns[: len(keep)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]] + ["score double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, y = pdf[[f"_x{i}" for i in range(len(features))]].to_numpy(), pdf[[f"_y{i}" for i in range(len(targets))]].to_numpy()
            yield pdf[names].assign(score=((model.predict(x) - y) ** 2).mean(axis=1))

    return rows.mapInPandas(run, schema)


def save_weights(model: Mlp | EdgeConvEncoder, path: str) -> None:
    """Weights with the model's kind and shape, as a local .npz file of the driver."""
    if isinstance(model, Mlp):
        np.savez(path, kind="mlp", shape=np.array(model.sizes), **{f"{n}{i}": p for i, layer in enumerate(model.layers) for n, p in zip("wb", layer)})
    else:
        np.savez(path, kind="edgeconv", shape=np.array([model.features, model.width, model.smallest, model.k]), **{f"{n}.{i}": p for n, pair in model.weights.items() for i, p in enumerate(pair)})


def load_weights(path: str, kind: type) -> Mlp | EdgeConvEncoder:
    """A saved model; one of another kind than asked for is an error."""
    with np.load(path) as f:
        if str(f["kind"]) != {Mlp: "mlp", EdgeConvEncoder: "edgeconv"}[kind]:
            raise TypeError(f"{path} holds a model of kind {f['kind']}")
        shape = f["shape"].tolist()
        if kind is Mlp:
            return Mlp(tuple(shape), layers=[[f[f"w{i}"], f[f"b{i}"]] for i in range(len(shape) - 1)])
        names = {k.rpartition(".")[0] for k in f.files if "." in k}
        return EdgeConvEncoder(*shape, weights={n: (f[f"{n}.0"], f[f"{n}.1"]) for n in names})
