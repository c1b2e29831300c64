"""Graph and token networks over jets: shapes, starting weights, losses and scores of one batch, as functions of a flat weight vector.

A network never sees more than a batch of jets inside a task; `training` spreads batches over Spark. Jets of a batch are laid out as
(jets, nodes, features) with a mask of the true nodes. What is random (masked tokens, dropout) comes from hashes of the
jet's key and a salt, so it is the same wherever a jet is processed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarkflow.operators import gradients as g
from quarkflow.operators.gradients import Array, Node
from quarkflow.operators.models import assignments


@dataclass
class Jets:
    """ids, labels: of each jet; keys: what its random draws go by; x: (jets, nodes, features), standardised; place: the first two features as they were; valid: true nodes."""

    ids: Array
    keys: Array
    labels: Array
    x: Array
    place: Array
    valid: Array

    @property
    def counts(self) -> Array:
        return self.valid.sum(1)


#: Pairs of nodes that jets which are looked at together may have (one jet may have more): attention and neighbours hold numbers for each.
PAIRS = 1 << 18
#: Jets of one size that are looked at without those of others.
RUN = 64
#: Nodes of jets of one size up to which messages are made for all pairs, the far ones masked: beyond, the pairs outgrow the edges.
STACKED = 7


def jets_of(batch: pa.RecordBatch, mean: Array, std: Array, size: int, least: int = 0) -> Iterator[Jets]:
    """The batch's jets (columns id, key, label, x: lists of feature lists), at most `size` and PAIRS together and of like numbers of nodes (of one number where RUN jets have it); each counts as `least` nodes at least. Read from the lists' buffers."""
    x = batch.column("x")
    n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
    first = np.cumsum(n) - n
    ids, keys, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "label"))
    order = np.argsort(n, kind="stable")
    ordered, at = n[order], 0
    pairs = np.maximum(np.maximum(ordered, least), 1) ** 2
    while at < len(order):
        most = np.arange(1, 1 + len(order[at : at + size])) * pairs[at : at + size]
        end = at + max(1, int(np.searchsorted(most, PAIRS, side="right")))
        run = int(np.searchsorted(ordered, ordered[at], side="right"))
        rows = order[at : run if at + RUN <= run < end else end]
        at += len(rows)
        node = np.arange(max(1, n[rows].max(initial=0)))
        valid = node < n[rows][:, None]
        raw = np.zeros((*valid.shape, len(mean)))
        raw[valid] = flat[(first[rows][:, None] + node)[valid]]
        yield Jets(ids[rows], keys[rows].astype(np.int64), labels[rows].astype(float), np.where(valid[..., None], (raw - mean) / std, 0.0), raw[..., :2], valid)


def hashed(keys: Array, n: int, *salt: int) -> Array:
    """(keys, n) uniform numbers in [0, 1) that the key, the place and the salt fix."""
    h = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for s in salt:
        h ^= np.uint64(s & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def nearest(points: Array, valid: Array, k: int) -> tuple[Array, Array]:
    """(numbers of the k nearest other nodes of each node, by distance, then number; which of them are there). k is clamped to a jet's other nodes."""
    n = points.shape[1]
    gap = np.zeros((len(points), n, n))
    for i in range(points.shape[2]):
        off = points[:, :, None, i] - points[:, None, :, i]
        gap += off * off
    gap[:, np.arange(n), np.arange(n)] = np.inf
    if not valid.all():
        gap[~(valid[:, :, None] & valid[:, None, :])] = np.inf
    at = np.argsort(gap, axis=2, kind="stable")[:, :, : max(1, min(k, n - 1))]
    return at, np.isfinite(np.take_along_axis(gap, at, 2))


def linked(jets: Jets, k: int) -> tuple[Array, ...]:
    """nearest() by place and the edges by the node they come from, for several layers on one graph."""
    at, there = nearest(jets.place, jets.valid, k)
    return at, there, *g.incoming(at)


@dataclass(frozen=True)
class Network:
    """What all networks share. Subclasses say their shapes and, for a batch, the losses (values and weights of the terms of a mean)."""

    features: int

    def shapes(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    def least(self) -> int:
        """Nodes that every jet is worked on as, at least."""
        return 0

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        raise NotImplementedError

    def latents(self, w: dict[str, Node], jets: Jets) -> Array:
        raise NotImplementedError

    def scores(self, w: dict[str, Node], jets: Jets, salt: int) -> Array:
        """One number per jet: its mean loss."""
        values, weight = self.losses(w, jets, salt, False)
        total = weight.sum(1)
        return np.where(total > 0, (values.value * weight).sum(1) / np.where(total > 0, total, 1), 0.0)

    def config(self) -> dict:
        return asdict(self)

    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes().values())

    def weights(self, flat: Array) -> dict[str, Node]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            out[name] = Node(flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        return out

    def initial(self, seed: int) -> Array:
        """Matrices and their biases uniform within 1 / sqrt(inputs), learned tokens near 0, scales 1, shifts 0."""
        rng, parts, inputs = np.random.default_rng(seed), [], 1
        for name, shape in self.shapes().items():
            kind = name.rpartition(".")[2]
            if kind in ("w", "b"):
                inputs = shape[0] if kind == "w" else inputs
                part = rng.uniform(-1, 1, shape) / np.sqrt(inputs)
            else:
                part = {"scale": np.ones(shape), "shift": np.zeros(shape)}.get(kind)
                part = rng.normal(0, 0.02, shape) if part is None else part
            parts.append(part.ravel())
        return np.concatenate(parts)


def dense(name: str, n: int, m: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.w": (n, m), f"{name}.b": (m,)}


def normed(name: str, n: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.scale": (n,), f"{name}.shift": (n,)}


def linear(w: dict[str, Node], name: str, x: Node) -> Node:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def norm(w: dict[str, Node], name: str, x: Node) -> Node:
    return g.layer_norm(x) * w[f"{name}.scale"] + w[f"{name}.shift"]


# --- graphs -------------------------------------------------------------------------------------------------------


def edge_shapes(name: str, n: int, inner: int, m: int) -> dict[str, tuple[int, ...]]:
    return dense(f"{name}.edge", 2 * n, inner) | dense(f"{name}.out", inner, m)


def edge_conv(w: dict[str, Node], name: str, x: Node, near: tuple[Array, ...], slope: float = 0.0, bounded: bool = False) -> Node:
    """The largest message over a node's edges, each a two-layer function of the node and its neighbour's difference; 0 without an edge."""
    at, there, *come = near
    edge, out = ((w[f"{name}.{layer}.w"], w[f"{name}.{layer}.b"]) for layer in ("edge", "out"))
    largest = g.edge_largest(x, edge, out, at, there, come or g.incoming(at), slope)
    return g.tanh(largest) if bounded else largest  # the largest of the bounds is the bound of the largest


@dataclass(frozen=True)
class EdgeConvClassifier(Network):
    """Two edge convolutions on the given graph, neighbours anew among the latent nodes before each of two further ones, the largest node of each number, two layers; the log odds of label 1."""

    smallest: int = 8
    k: int = 8
    reduced_k: int = 8

    def shapes(self) -> dict[str, tuple[int, ...]]:
        s, f = self.smallest, self.features
        return edge_shapes("conv1", f, 2 * s, 2 * s) | edge_shapes("conv2", 2 * s, s, s) | edge_shapes("conv3", s, s, s) | edge_shapes("conv4", s, 2 * s, 2 * s) | dense("hidden", 2 * s, 2 * f) | dense("odds", 2 * f, 1)

    def encoded(self, w: dict[str, Node], jets: Jets) -> Node:
        near = linked(jets, self.k)
        return g.leaky(edge_conv(w, "conv2", g.leaky(edge_conv(w, "conv1", Node(jets.x), near)), near))

    def odds(self, w: dict[str, Node], jets: Jets) -> Node:
        if 2 <= jets.valid.shape[1] <= STACKED and jets.valid.all():
            return self._odds_of_stack(w, jets)
        x = self.encoded(w, jets)
        for layer in ("conv3", "conv4"):
            x = g.leaky(edge_conv(w, layer, x, nearest(x.value, jets.valid, self.reduced_k)))
        return self._pooled_odds(w, g.largest(x, jets.valid[..., None], 1))

    def _pooled_odds(self, w: dict[str, Node], pooled: Node) -> Node:
        return linear(w, "odds", g.leaky(linear(w, "hidden", pooled)))

    def _odds_of_stack(self, w: dict[str, Node], jets: Jets) -> Node:
        """odds() of jets of one size, all pairs of nodes at once."""
        x = Node(np.ascontiguousarray(jets.x.transpose(1, 0, 2)))
        near = g.pairs_near(jets.place.transpose(1, 0, 2), self.k)
        for layer in ("conv1", "conv2", "conv3", "conv4"):
            if layer in ("conv3", "conv4"):
                near = g.pairs_near(x.value, self.reduced_k)
            edge, out = ((w[f"{layer}.{side}.w"], w[f"{layer}.{side}.b"]) for side in ("edge", "out"))
            x = g.leaky(g.pair_largest(x, edge, out, near))
        return self._pooled_odds(w, g.largest(x, np.True_, 0))

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        return g.logistic_loss(self.odds(w, jets), jets.labels[:, None]), np.ones((len(jets.ids), 1))

    def scores(self, w: dict[str, Node], jets: Jets, salt: int) -> Array:
        """The probability of label 1."""
        return 0.5 * (1 + np.tanh(0.5 * self.odds(w, jets).value[:, 0]))

    def latents(self, w: dict[str, Node], jets: Jets) -> Array:
        return _mean_nodes(self.encoded(w, jets).value, jets)


def _mean_nodes(x: Array, jets: Jets) -> Array:
    return (x * jets.valid[..., None]).sum(1) / np.maximum(jets.counts, 1)[:, None]


def _node_errors(out: Node, jets: Jets) -> tuple[Node, Array]:
    """Squared errors per node, its features' mean."""
    off = out - jets.x
    return (off * off).sum(2) * (1 / jets.x.shape[2]), jets.valid.astype(float)


@dataclass(frozen=True)
class GraphAutoencoder(Network):
    """Embedding, normed edge convolutions of one width down to `smallest` numbers a node and back up, each added to its input where widths agree; a jet's score is its reconstruction error."""

    width: int = 32
    smallest: int = 4
    layers: int = 2
    k: int = 3
    wide: int = 8

    def _sides(self) -> list[tuple[str, int, int]]:
        down = [(f"down{i}", self.width, self.width if i < self.layers - 1 else self.smallest) for i in range(self.layers)]
        return down + [(f"up{i}", self.smallest if i == 0 else self.width, self.width) for i in range(self.layers)]

    def shapes(self) -> dict[str, tuple[int, ...]]:
        out = dense("embed", self.features, self.width)
        for name, n, m in self._sides():
            out |= normed(f"{name}.norm", n) | edge_shapes(name, n, self.wide * self.width, m)
        return out | dense("unembed", self.width, self.features)

    def _through(self, w: dict[str, Node], x: Node, near: tuple[Array, ...], side: str) -> Node:
        last = f"up{self.layers - 1}"
        for name, n, m in self._sides():
            if name.startswith(side):
                y = edge_conv(w, name, norm(w, f"{name}.norm", x), near, 0.1, name != last)
                x = x + y if n == m else y
        return x

    def encoded(self, w: dict[str, Node], jets: Jets) -> tuple[Node, tuple[Array, ...]]:
        near = linked(jets, self.k)
        return self._through(w, linear(w, "embed", Node(jets.x)), near, "down"), near

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        z, near = self.encoded(w, jets)
        return _node_errors(linear(w, "unembed", self._through(w, z, near, "up")), jets)

    def latents(self, w: dict[str, Node], jets: Jets) -> Array:
        return _mean_nodes(self.encoded(w, jets)[0].value, jets)


# --- tokens -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenNetwork(Network):
    """What the token networks share: pre-norm blocks of masked attention, and tokens from features and places."""

    width: int = 16
    layers: int = 2
    heads: int = 2
    dropout: float = 0.1

    def __post_init__(self) -> None:
        if self.features <= 2 or self.width % self.heads or not 0 <= self.dropout < 1:
            raise ValueError("tokens have more than their two places as features, heads divide the width, dropout is in [0, 1)")

    def block_shapes(self, side: str) -> dict[str, tuple[int, ...]]:
        out, d = {}, self.width
        for i in range(self.layers):
            name = f"{side}{i}"
            out |= normed(f"{name}.before", d) | dense(f"{name}.qkv", d, 3 * d) | dense(f"{name}.mix", d, d)
            out |= normed(f"{name}.between", d) | dense(f"{name}.wide", d, 4 * d) | dense(f"{name}.narrow", 4 * d, d)
        return out | normed(f"{side}.end", d)

    def place_shapes(self) -> dict[str, tuple[int, ...]]:
        return dense("place1", 2, self.width) | dense("place2", self.width, self.width)

    def places(self, w: dict[str, Node], jets: Jets) -> Node:
        return linear(w, "place2", g.gelu(linear(w, "place1", Node(jets.x[..., :2]))))

    def _dropped(self, x: Node, jets: Jets, salt: int, place: int, training: bool) -> Node:
        if not training or not self.dropout:
            return x
        keep = hashed(jets.keys, x.shape[1] * x.shape[2], salt, place).reshape(x.shape) >= self.dropout
        return x * (keep / (1 - self.dropout))

    def blocks(self, w: dict[str, Node], side: str, x: Node, valid: Array, jets: Jets, salt: int, training: bool) -> Node:
        """Attention among a jet's valid tokens, then two layers, each on normed input and added to it; a last norm."""
        jets_, n, d = x.shape
        h, e = self.heads, d // self.heads
        allowed = np.broadcast_to(valid[:, None, None, :], (jets_, h, n, n))
        for i in range(self.layers):
            name = f"{side}{i}"
            qkv = linear(w, f"{name}.qkv", norm(w, f"{name}.before", x)).reshape(jets_, n, 3, h, e).transposed(2, 0, 3, 1, 4)
            q, k, v = (qkv.part(j) for j in range(3))
            seen = g.softmax((q @ k.transposed(0, 1, 3, 2)) * (1 / math.sqrt(e)), allowed) @ v
            mixed = linear(w, f"{name}.mix", seen.transposed(0, 2, 1, 3).reshape(jets_, n, d))
            x = x + self._dropped(mixed, jets, salt, 2 * i + (side == "decode") * 100, training)
            wide = g.gelu(linear(w, f"{name}.wide", norm(w, f"{name}.between", x)))
            x = x + self._dropped(linear(w, f"{name}.narrow", wide), jets, salt, 2 * i + 1 + (side == "decode") * 100, training)
        return norm(w, f"{side}.end", x)

    def with_class(self, w: dict[str, Node], tokens: Node, jets: Jets) -> tuple[Node, Array]:
        """(tokens after a class token, which are valid)."""
        first = g.spread(w["class.token"], (tokens.shape[0], 1, self.width))
        return g.joined([first, tokens], 1), np.concatenate([np.ones((tokens.shape[0], 1), bool), jets.valid], 1)


@dataclass(frozen=True)
class MaskedTransformer(TokenNetwork):
    """Features of a share of the tokens (half-even round(share * n), by hash of id and salt) are hidden behind a learned one and predicted from the others and the places."""

    ratio: float = 0.3

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, f = self.width, self.features - 2
        return dense("embed", f, d) | self.place_shapes() | {"class.token": (1, 1, d), "hidden.token": (1, 1, d)} | self.block_shapes("encode") | dense("head", d, f)

    def masked(self, jets: Jets, salt: int) -> Array:
        """Which tokens are hidden: those of the smallest hashes."""
        draw = np.where(jets.valid, hashed(jets.keys, jets.valid.shape[1], salt, 7), 2.0)
        rank = np.argsort(np.argsort(draw, axis=1, kind="stable"), axis=1, kind="stable")
        return jets.valid & (rank < np.round(jets.counts * self.ratio)[:, None])

    def _encoded(self, w: dict[str, Node], jets: Jets, mask: Array, salt: int, training: bool) -> Node:
        hide = mask[..., None].astype(float)
        tokens = linear(w, "embed", Node(jets.x[..., 2:])) * (1 - hide) + w["hidden.token"] * hide + self.places(w, jets)
        x, valid = self.with_class(w, tokens, jets)
        return self.blocks(w, "encode", x, valid, jets, salt, training)

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        mask = self.masked(jets, salt)
        off = linear(w, "head", self._encoded(w, jets, mask, salt, training).part(slice(None), slice(1, None))) - jets.x[..., 2:]
        return (off * off).sum(2) * (1 / (self.features - 2)), mask.astype(float)

    def latents(self, w: dict[str, Node], jets: Jets) -> Array:
        return self._encoded(w, jets, np.zeros_like(jets.valid), 0, False).value[:, 0]


@dataclass(frozen=True)
class _ClassBottleneck(TokenNetwork):
    latent: int = 4

    def _base(self) -> dict[str, tuple[int, ...]]:
        d = self.width
        return dense("embed", self.features, d) | self.place_shapes() | {"class.token": (1, 1, d)} | self.block_shapes("encode") | dense("squeeze", d, self.latent) | dense("unsqueeze", self.latent, d)

    def encoded(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> Node:
        """(jets, latent): what the class token has taken up."""
        x, valid = self.with_class(w, linear(w, "embed", Node(jets.x)) + self.places(w, jets), jets)
        return linear(w, "squeeze", self.blocks(w, "encode", x, valid, jets, salt, training).part(slice(None), 0))

    def context(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> Node:
        z = linear(w, "unsqueeze", self.encoded(w, jets, salt, training))
        return z.reshape(z.shape[0], 1, z.shape[1])

    def latents(self, w: dict[str, Node], jets: Jets) -> Array:
        return self.encoded(w, jets, 0, False).value


@dataclass(frozen=True)
class ClassTokenAutoencoder(_ClassBottleneck):
    """A jet through one class token's latent numbers; learned slots with these as context are decoded to particles. Loss `set`: slots are matched to particles at least cost, anew in each step; `index`: slot i is particle i."""

    slots: int = 16
    loss: str = "set"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.loss not in ("set", "index"):
            raise ValueError(f"unknown loss {self.loss}")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return self._base() | {"slot.token": (1, self.slots, self.width)} | self.block_shapes("decode") | dense("head", self.width, self.features)

    def least(self) -> int:
        return self.slots

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        n = jets.valid.shape[1]
        if jets.counts.max(initial=0) > self.slots:
            raise ValueError(f"{jets.counts.max()} particles for {self.slots} slots")
        out = g.spread(w["slot.token"], (len(jets.ids), self.slots, self.width)) + self.context(w, jets, salt, training)
        out = linear(w, "head", self.blocks(w, "decode", out, np.ones((len(jets.ids), self.slots), bool), jets, salt, training))
        at = np.tile(np.arange(n), (len(jets.ids), 1)) % self.slots
        if self.loss == "set":
            cost = ((out.value[:, None, :, :] - jets.x[:, : self.slots, None, :]) ** 2).mean(3)
            slot = assignments(cost, jets.counts)
            at[:, : self.slots] = np.where(slot >= 0, slot, at[:, : self.slots])
        mine = g.gathered(out, at[..., None]).reshape(*at.shape, self.features)
        values, weight = _node_errors(mine, jets)
        # The matched cost is a mean over a jet's particles, then over jets; by index it is one over all particles.
        return values, weight / np.maximum(jets.counts, 1)[:, None] if self.loss == "set" else weight


@dataclass(frozen=True)
class TokenAutoencoder(_ClassBottleneck):
    """As above, but each particle is decoded from a query made of its own place, with the latent numbers as context (attention to one token would give the same sum), and compared with itself."""

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return self._base() | self.block_shapes("decode") | dense("head", self.width, self.features)

    def losses(self, w: dict[str, Node], jets: Jets, salt: int, training: bool) -> tuple[Node, Array]:
        queries = self.places(w, jets) + self.context(w, jets, salt, training)
        return _node_errors(linear(w, "head", self.blocks(w, "decode", queries, jets.valid, jets, salt, training)), jets)


KINDS = {c.__name__: c for c in (EdgeConvClassifier, GraphAutoencoder, MaskedTransformer, ClassTokenAutoencoder, TokenAutoencoder)}
