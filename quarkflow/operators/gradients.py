"""Reverse-mode gradients for the few array operations that graph and token networks are made of.

Helpers of the gradient steps in `training`: they see one batch of jets inside a Spark task. A Node holds a value and,
for each input, how a gradient of its value becomes one of the input's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Array = np.ndarray


class Node:
    def __init__(self, value: Array, inputs: tuple[tuple[Node, Callable[[Array], Array]], ...] = ()) -> None:
        self.value, self.inputs = np.asarray(value, float), inputs
        self.grad: Array | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other: Node | Array | float) -> Node:
        other = node(other)
        return Node(self.value + other.value, ((self, lambda g: summed_to(g, self.shape)), (other, lambda g: summed_to(g, other.shape))))

    def __sub__(self, other: Node | Array | float) -> Node:
        return self + node(other) * -1.0

    def __mul__(self, other: Node | Array | float) -> Node:
        other = node(other)
        return Node(self.value * other.value, ((self, lambda g: summed_to(g * other.value, self.shape)), (other, lambda g: summed_to(g * self.value, other.shape))))

    def __matmul__(self, other: Node) -> Node:
        """Matrices in the last two dimensions; the left may have leading ones, the right as many or none."""
        a, b = self.value, other.value
        if b.ndim == 2:
            right = lambda g: a.reshape(-1, a.shape[-1]).T @ g.reshape(-1, g.shape[-1])
        else:
            right = lambda g: np.swapaxes(a, -1, -2) @ g
        return Node(a @ b, ((self, lambda g: g @ np.swapaxes(b, -1, -2)), (other, right)))

    def reshape(self, *shape: int) -> Node:
        return Node(self.value.reshape(shape), ((self, lambda g: g.reshape(self.shape)),))

    def transposed(self, *axes: int) -> Node:
        return Node(self.value.transpose(axes), ((self, lambda g: g.transpose(np.argsort(axes))),))

    def part(self, *at) -> Node:
        """Basic slices."""

        def back(g: Array) -> Array:
            out = np.zeros(self.shape)
            out[at] = g
            return out

        return Node(self.value[at], ((self, back),))

    def sum(self, *axes: int) -> Node:
        return Node(self.value.sum(axis=axes or None), ((self, lambda g: np.broadcast_to(np.expand_dims(g, axes) if axes else g, self.shape)),))

    def backward(self, grad: Array | float = 1.0) -> None:
        """Sets grad of every node that this one is made of."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            n, done = stack.pop()
            if done:
                order.append(n)
            elif id(n) not in seen:
                seen.add(id(n))
                stack += [(n, True), *((m, False) for m, _ in n.inputs)]
        self.grad = np.broadcast_to(np.asarray(grad, float), self.shape)
        for n in reversed(order):
            for m, back in n.inputs:
                g = back(n.grad)
                m.grad = g if m.grad is None else m.grad + g


def node(x: Node | Array | float) -> Node:
    return x if isinstance(x, Node) else Node(np.asarray(x, float))


def summed_to(g: Array, shape: tuple[int, ...]) -> Array:
    """g summed over what broadcasting has added to shape."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=wide, keepdims=True) if wide else g


def leaky(x: Node, slope: float = 0.0) -> Node:
    """x above 0, slope * x below."""
    if not slope:
        above = x.value > 0
        return Node(np.maximum(x.value, 0.0), ((x, lambda g: g * above),))
    rate = np.where(x.value > 0, 1.0, slope)
    return Node(x.value * rate, ((x, lambda g: g * rate),))


def tanh(x: Node) -> Node:
    y = np.tanh(x.value)
    return Node(y, ((x, lambda g: g * (1 - y * y)),))


def gelu(x: Node) -> Node:
    """The smooth rectifier, by its tanh form."""
    v, c = x.value, np.sqrt(2 / np.pi)
    square = v * v
    t = square * (0.044715 * c)
    t += c
    t *= v
    np.tanh(t, out=t)
    half = t + 1
    half *= 0.5

    def back(g: Array) -> Array:
        inner = square * (3 * 0.044715 * c)
        inner += c
        inner *= v
        inner *= 1 - half
        inner *= 2 * half  # half of 1 - t * t
        inner += half
        inner *= g
        return inner

    return Node(v * half, ((x, back),))


def row_sums(x: Array) -> Array:
    """Sums over the last dimension, kept: a product with ones is quicker than a sum over a short dimension."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones((x.shape[-1], 1))).reshape(*x.shape[:-1], 1)


def layer_norm(x: Node, eps: float = 1e-5) -> Node:
    """The last dimension with mean 0 and variance 1."""
    n = x.shape[-1]
    off = x.value - row_sums(x.value) / n
    scale = 1 / np.sqrt(row_sums(off * off) / n + eps)
    y = off * scale

    def back(g: Array) -> Array:
        out = g - row_sums(g) / n
        out -= y * (row_sums(g * y) / n)
        out *= scale
        return out

    return Node(y, ((x, back),))


def softmax(x: Node, allowed: Array) -> Node:
    """Over the last dimension, of the allowed places alone; a row without one gives zeros."""
    if allowed.all():
        p = x.value - x.value.max(-1, keepdims=True)
        np.exp(p, out=p)
        p /= row_sums(p)
    else:
        top = np.where(allowed, x.value, -np.inf).max(-1, keepdims=True)
        e = np.where(allowed, np.exp(np.minimum(x.value - np.where(np.isfinite(top), top, 0), 0)), 0.0)
        total = e.sum(-1, keepdims=True)
        p = e / np.where(total > 0, total, 1)

    def back(g: Array) -> Array:
        out = g - row_sums(g * p)
        out *= p
        return out

    return Node(p, ((x, back),))


def largest(x: Node, allowed: Array, axis: int) -> Node:
    """The largest allowed value along axis, whose gradient goes to that place (the first of equals); 0 without one."""
    masked = np.where(allowed, x.value, -np.inf)
    at = np.expand_dims(masked.argmax(axis), axis)
    y = np.take_along_axis(masked, at, axis)
    found = np.isfinite(y)

    def back(g: Array) -> Array:
        out = np.zeros(x.shape)
        np.put_along_axis(out, at, np.where(found, np.expand_dims(g, axis), 0.0), axis)
        return out

    return Node(np.where(found, y, 0.0).squeeze(axis), ((x, back),))


def gathered(x: Node, at: Array) -> Node:
    """x: (jets, nodes, features), at: (jets, nodes, k) numbers of nodes; (jets, nodes, k, features)."""
    jets, nodes, features = x.shape
    rows = (np.arange(jets)[:, None, None] * nodes + at).ravel()

    def back(g: Array) -> Array:
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out = np.zeros((jets * nodes, features))
        if len(first):
            out[rows[order[first]]] = np.add.reduceat(g.reshape(-1, features)[order], first, axis=0)
        return out.reshape(x.shape)

    return Node(x.value.reshape(-1, features)[rows].reshape(*at.shape, features), ((x, back),))


def incoming(at: Array) -> tuple[Array, Array, Array]:
    """(edges of at in order of the node that they come from, the first of each such node, these nodes)."""
    rows = (np.arange(at.shape[0])[:, None, None] * at.shape[1] + at).ravel()
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    return order, first, rows[order[first]]


def edge_largest(x: Node, edge: tuple[Node, Node], out: tuple[Node, Node], at: Array, there: Array, come: tuple[Array, Array, Array], slope: float) -> Node:
    """Of each node the largest message of its edges, 0 without one: (node, neighbour's difference) through the layer edge (weights, bias), values below 0 times slope, and the layer out.

    The first layer is linear in node and neighbour, so it is applied once a node and not once an edge; the gradient
    of a largest message goes to its edge alone.
    """
    (w1, b1), (w2, b2) = edge, out
    jets, nodes, features = x.shape
    k, inner, width = at.shape[2], w1.shape[1], w2.shape[1]
    flat = x.value.reshape(-1, features)
    centre, other = w1.value[:features] - w1.value[features:], w1.value[features:]
    rows = (np.arange(jets)[:, None, None] * nodes + at).ravel()
    h = (flat @ other)[rows].reshape(-1, k, inner)
    h += (flat @ centre + b1.value)[:, None, :]
    h = np.maximum(h, slope * h) if slope else np.maximum(h, 0.0, out=h)
    m = (h.reshape(-1, inner) @ w2.value).reshape(-1, k, width)
    seen = there.reshape(-1, k)
    if not seen.all():
        m[~seen] = -np.inf
    best, top = np.zeros((len(m), width), np.int8 if k < 128 else np.int64), m[:, 0].copy()
    for i in range(1, k):  # the first of equals
        more = m[:, i] > top
        best[more] = i
        np.maximum(top, m[:, i], out=top)
    lone = ~seen.any(1)
    y = top + b2.value
    y[lone] = 0.0
    found: dict[str, Array] = {}

    def back(g: Array) -> dict[str, Array]:
        if not found:
            g = g.reshape(-1, width)
            g = np.where(lone[:, None], 0.0, g) if lone.any() else g
            gm = (g[:, None, :] * (best[:, None, :] == np.arange(k)[None, :, None])).reshape(-1, width)
            found["b2"], found["w2"] = g.sum(0), h.reshape(-1, inner).T @ gm
            gh = (gm @ w2.value.T).reshape(-1, k, inner)
            if slope:
                np.multiply(gh, slope, out=gh, where=h <= 0)
            else:
                gh *= h > 0
            mine, order, first, of = gh.sum(1), *come
            gh = gh.reshape(-1, inner)
            narrow = features < inner  # sums by node go over the narrower side of the first layer
            sent = gh @ other.T if narrow else gh
            yours = np.zeros((len(flat), sent.shape[1]))
            if len(first):
                yours[of] = np.add.reduceat(sent[order], first, axis=0)
            by_centre, by_other = flat.T @ mine, flat[rows].T @ gh if narrow else flat.T @ yours
            found["w1"], found["b1"] = np.concatenate([by_centre, by_other - by_centre]), mine.sum(0)
            found["x"] = (mine @ centre.T + (yours if narrow else yours @ other.T)).reshape(x.shape)
        return found

    return Node(y.reshape(jets, nodes, width), tuple((n, lambda g, name=name: back(g)[name]) for name, n in (("x", x), ("w1", w1), ("b1", b1), ("w2", w2), ("b2", b2))))


def pairs_near(points: Array, k: int) -> Array | None:
    """Of a stack of jets of one size, laid out (nodes, jets, features): [r - 1, a, jet] whether node (a + r) modulo the nodes is one of the k nearest others of node a, by distance, then number. None if all are."""
    n, jets, features = points.shape
    if n - 1 <= k:
        return None
    gap, rank = np.zeros((n - 1, n, jets)), np.zeros((n - 1, n, jets), np.int16)
    for r in range(1, n // 2 + 1):
        for i in range(features):
            off = points[..., i] - np.roll(points[..., i], -r, 0)
            gap[r - 1] += off * off
        gap[n - r - 1] = np.roll(gap[r - 1], r, 0)  # the same pairs from their other ends
    number = (np.arange(n) + np.arange(1, n)[:, None]) % n
    for r in range(n - 1):
        for s in range(r):
            first = np.where((number[s] < number[r])[:, None], gap[s] <= gap[r], gap[s] < gap[r])
            rank[r] += first
            rank[s] += ~first
    return rank < k


def pair_largest(x: Node, edge: tuple[Node, Node], out: tuple[Node, Node], near: Array | None, slope: float = 0.0) -> Node:
    """edge_largest() of a stack of jets of one size, laid out (nodes, jets, features), whose edges are all pairs or those of pairs_near(): a node's neighbours are slices of the stack, so nothing is gathered or sorted."""
    (w1, b1), (w2, b2) = edge, out
    n, jets, features = x.shape
    k, inner, width = n - 1, w1.shape[1], w2.shape[1]
    flat = x.value.reshape(-1, features)
    centre, other = w1.value[:features] - w1.value[features:], w1.value[features:]
    mine, yours = (flat @ centre + b1.value).reshape(n, jets, inner), (flat @ other).reshape(n, jets, inner)
    h = np.empty((k, n, jets, inner))
    for r in range(1, n):
        np.add(mine[: n - r], yours[r:], out=h[r - 1, : n - r])
        np.add(mine[n - r :], yours[:r], out=h[r - 1, n - r :])
    h = np.maximum(h, slope * h) if slope else np.maximum(h, 0.0, out=h)
    m = (h.reshape(-1, inner) @ w2.value).reshape(k, n, jets, width)
    if near is not None:
        m[~near] = -np.inf
    top = m.max(0)
    chosen = m == top
    open_ = ~chosen[0]
    for i in range(1, k):  # the first of equals
        chosen[i] &= open_
        open_ ^= chosen[i]
    top += b2.value
    found: dict[str, Array] = {}

    def back(g: Array) -> dict[str, Array]:
        if not found:
            gm = np.multiply(g, chosen).reshape(-1, width)
            found["b2"], found["w2"] = g.reshape(-1, width).sum(0), h.reshape(-1, inner).T @ gm
            gh = (gm @ w2.value.T).reshape(h.shape)
            gh *= np.where(h > 0, 1.0, slope) if slope else h > 0
            to_mine, to_yours = gh.sum(0), np.zeros((n, jets, inner))
            for r in range(1, n):
                to_yours[r:] += gh[r - 1, : n - r]
                to_yours[:r] += gh[r - 1, n - r :]
            to_mine, to_yours = to_mine.reshape(-1, inner), to_yours.reshape(-1, inner)
            by_centre = flat.T @ to_mine
            found["w1"], found["b1"] = np.concatenate([by_centre, flat.T @ to_yours - by_centre]), to_mine.sum(0)
            found["x"] = (to_mine @ centre.T + to_yours @ other.T).reshape(x.shape)
        return found

    return Node(top, tuple((i, lambda g, name=name: back(g)[name]) for name, i in (("x", x), ("w1", w1), ("b1", b1), ("w2", w2), ("b2", b2))))


def joined(parts: list[Node], axis: int) -> Node:
    """Concatenation."""
    ends = np.cumsum([p.shape[axis] for p in parts])

    def back(i: int) -> Callable[[Array], Array]:
        return lambda g: np.split(g, ends[:-1], axis)[i]

    return Node(np.concatenate([p.value for p in parts], axis), tuple((p, back(i)) for i, p in enumerate(parts)))


def spread(x: Node, shape: tuple[int, ...]) -> Node:
    """x broadcast to shape."""
    return Node(np.broadcast_to(x.value, shape), ((x, lambda g: summed_to(g, x.shape)),))


def logistic_loss(x: Node, label: Array) -> Node:
    """-log likelihood of 0/1 labels, x being the log odds."""
    v = x.value
    p = 0.5 * (1 + np.tanh(0.5 * v))
    return Node(np.maximum(v, 0) - v * label + np.log1p(np.exp(-np.abs(v))), ((x, lambda g: g * (p - label)),))
