"""Neighbour graphs inside groups (a jet's particles): row-local pairs and a ranked window.

Nodes: (jet_id, idx, ...). A group's nodes are gathered in one row and paired there; the window by (jet_id, centre) goes on
in the partitions of that exchange by jet_id and keeps k rows through a rank limit before and after it. Ties go by
distance rounded to 12 digits, then the neighbour's number. Groups of fewer than two nodes have no graph. Edges: (jet_id, center, neighbor, d, rank).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.functions.expr import PI, TWO_PI, d, momentum, pair_mass, zero_unless_finite

METHODS = ("eta_phi", "all_features", "fully_connected", "mass_knn", "hybrid_knn")
TINY = 1e-6


def _sides(nodes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    a = nodes.select("jet_id", F.col("idx").alias("center"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = nodes.select("jet_id", F.col("idx").alias("neighbor"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a, b


def pairs(nodes: DataFrame, columns: list[str], self_pairs: bool = False, least: int = 1) -> DataFrame:
    """Ordered pairs of a group's nodes, columns prefixed a_ (centre) and b_ (neighbour), of groups of `least` nodes and more."""
    group = F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("_nodes")
    rows = nodes.where("jet_id is not null").groupBy("jet_id").agg(group).where(F.size("_nodes") >= least)
    for end, name in (("a", "center"), ("b", "neighbor")):
        held = [c for c in rows.columns if c != "jet_id"]
        rows = rows.select("jet_id", *held, F.explode("_nodes").alias("_e"))
        rows = rows.select("jet_id", *held, F.col("_e.idx").alias(name), *(F.col(f"_e.{c}").alias(f"{end}_{c}") for c in columns))
    rows = rows.drop("_nodes")
    return rows if self_pairs else rows.where("center <> neighbor")


def nearest(pairs_: DataFrame, distance: Column, k: int, *keep: str) -> DataFrame:
    """The k nearest neighbours of every centre, with further columns to keep."""
    w = Window.partitionBy("jet_id", "center").orderBy(F.round("d", 12), "neighbor")
    ranked = pairs_.withColumn("d", distance).select("jet_id", "center", "neighbor", "d", *keep).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def _by_place() -> Column:
    x, y = F.col("a_eta") - F.col("b_eta"), F.col("a_phi") - F.col("b_phi")
    return F.sqrt(x * x + y * y)


def eta_phi(nodes: DataFrame, k: int) -> DataFrame:
    """k nearest in (eta, phi), phi not wrapped, no loops."""
    return nearest(pairs(nodes, ["eta", "phi"]), _by_place(), k)


def eta_phi_messages(nodes: DataFrame, k: int, features: list[str]) -> DataFrame:
    """edge_messages() of eta_phi(), whose pairs carry the features: edges are not joined to nodes."""
    held = list(dict.fromkeys(["eta", "phi", *features]))
    edges = nearest(pairs(nodes, held), _by_place(), k, *(f"{end}_{f}" for end in "ab" for f in features))
    return edges.select("jet_id", "center", "neighbor", *_messages(features))


def all_features(nodes: DataFrame, k: int, features: list[str]) -> DataFrame:
    """k nearest in the space of all features, no loops."""
    total = sum(((F.col(f"a_{f}") - F.col(f"b_{f}")) * (F.col(f"a_{f}") - F.col(f"b_{f}")) for f in features), d(0.0))
    return nearest(pairs(nodes, features), F.sqrt(total), k)


def fully_connected(nodes: DataFrame) -> DataFrame:
    """All ordered pairs with loops, of groups of two nodes and more."""
    return pairs(nodes, [], self_pairs=True, least=2)


def _kinematics(nodes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    clean = {c: zero_unless_finite(F.col(c)) for c in ("pt", "eta", "phi", "mass")}
    m = momentum(**clean)
    return nodes.select("jet_id", "idx", *(c.alias(n) for n, c in {**clean, **m}.items()), *(extra or []))


def _mass(floor: bool) -> Column:
    return pair_mass(*(F.col(f"a_{c}") + F.col(f"b_{c}") for c in ("e", "px", "py", "pz")), floor=floor)


def mass_knn(nodes: DataFrame, k: int) -> DataFrame:
    """k + 1 nearest by 1 / (pair mass + tiny), the node itself among the candidates."""
    rows = pairs(_kinematics(nodes), ["e", "px", "py", "pz"], self_pairs=True, least=2)
    return nearest(rows, d(1.0) / (_mass(False) + d(TINY)), k + 1)


def hybrid_knn(nodes: DataFrame, k: int, alpha: float = 0.3, soft_mass: str = "fj_msoftdrop") -> DataFrame:
    """k + 1 nearest by alpha * (distance scaled to the group's range) + (1 - alpha) * (soft mass / pair mass)."""
    columns = ["e", "px", "py", "pz", "eta", "phi"]
    rows = pairs(_kinematics(nodes, [soft_mass]), [*columns, soft_mass], self_pairs=True, least=2)
    turn = F.abs(F.col("a_phi") - F.col("b_phi"))
    turn = F.when(turn > d(PI), d(TWO_PI) - turn).otherwise(turn)
    x = F.col("a_eta") - F.col("b_eta")
    rows = rows.withColumn("_dr", F.sqrt(x * x + turn * turn)).withColumn("_m", _mass(True))
    whole = Window.partitionBy("jet_id")
    lo, hi = F.min("_dr").over(whole), F.max("_dr").over(whole)
    by_angle = (F.col("_dr") - lo) / (hi - lo + d(TINY))
    by_mass = d(1.0) / (F.col("_m") + d(TINY)) * (F.col(f"a_{soft_mass}") + d(TINY))
    rows = rows.withColumn("_mix", d(alpha) * by_angle + d(1 - alpha) * by_mass)
    return nearest(rows, F.col("_mix"), k + 1)


def build(nodes: DataFrame, method: str, k: int, features: list[str] | None = None, alpha: float = 0.3) -> DataFrame:
    """Edges by one of METHODS; k is clamped to a group's other nodes."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "eta_phi":
        return eta_phi(nodes, k)
    if method == "all_features":
        return all_features(nodes, k, features or [])
    if method == "fully_connected":
        return fully_connected(nodes)
    return mass_knn(nodes, k) if method == "mass_knn" else hybrid_knn(nodes, k, alpha)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end first."""
    return edges.select("jet_id", F.least("center", "neighbor").alias("a"), F.greatest("center", "neighbor").alias("b")).distinct()


def pooled(nodes: DataFrame, features: list[str], how: str = "max") -> DataFrame:
    """One row per group: the maximum or mean of each feature."""
    f = {"max": F.max, "mean": F.avg}[how]
    return nodes.groupBy("jet_id").agg(*(f(c).alias(f"{how}_{c}") for c in features))


def edge_messages(edges: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Edge inputs of a convolution: the centre's features and the neighbour's differences from them."""
    a, b = _sides(nodes, features)
    rows = edges.select("jet_id", "center", "neighbor").join(a, ["jet_id", "center"]).join(b, ["jet_id", "neighbor"])
    return rows.select("jet_id", "center", "neighbor", *_messages(features))


def _messages(features: list[str]) -> list[Column]:
    return [*(F.col(f"a_{f}").alias(f"x_{f}") for f in features), *((F.col(f"b_{f}") - F.col(f"a_{f}")).alias(f"dx_{f}") for f in features)]


def edge_max(messages: DataFrame, columns: list[str]) -> DataFrame:
    """The largest message of each column over a centre's edges."""
    return messages.groupBy("jet_id", "center").agg(*(F.max(c).alias(f"max_{c}") for c in columns))


def dense_layer(x: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """x (a column per input) times weights (a list per input) plus bias: a dense layer as compiled arithmetic, a column per output."""
    if not weights or len(weights) != len(x) or any(len(row) != len(bias) for row in weights):
        raise ValueError("a weight for each input and output, a bias for each output")
    return [sum((c * d(row[j]) for c, row in zip(x, weights)), d(0.0)) + d(bias[j]) for j in range(len(bias))]


def edge_layer(messages: DataFrame, features: list[str], first: tuple, second: tuple, slope: float = 0.0) -> DataFrame:
    """(jet_id, center, h): the learned edge convolution in the JVM. Of each edge (edge_messages()), (features of the centre, differences of the neighbour) go through two dense layers (weights, bias), values below 0 times slope between them; h is the largest message of each number."""
    inner = dense_layer([*(F.col(f"x_{f}") for f in features), *(F.col(f"dx_{f}") for f in features)], *first)
    rows = messages.select("jet_id", "center", *(v.alias(f"_i{i}") for i, v in enumerate(inner)))
    bent = [F.when(F.col(f"_i{i}") > 0, F.col(f"_i{i}")).otherwise(F.col(f"_i{i}") * d(slope)).alias(f"_i{i}") for i in range(len(inner))]
    out = dense_layer([F.col(f"_i{i}") for i in range(len(inner))], *second)
    rows = rows.select("jet_id", "center", *bent).select("jet_id", "center", *(v.alias(f"_m{i}") for i, v in enumerate(out)))
    largest = rows.groupBy("jet_id", "center").agg(*(F.max(f"_m{i}").alias(f"_m{i}") for i in range(len(out))))
    return largest.select("jet_id", "center", F.array(*(f"_m{i}" for i in range(len(out)))).alias("h"))


def top_k_pool(nodes: DataFrame, edges: DataFrame, features: list[str], weights: list[float], ratio: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each group's ceil(ratio * n) nodes of largest projection on weights, the smaller number of equals.

    Nodes: (jet_id, idx, features, score), features times the score, the tanh of the projection. Edges keep both ends.
    NULL and non-finite features count as 0.
    """
    norm = math.sqrt(sum(w * w for w in weights))
    if not norm or len(weights) != len(features):
        raise ValueError("one weight per feature, not all zero")
    clean = {f: zero_unless_finite(F.col(f)) for f in features}
    along = sum((clean[f] * d(w) for f, w in zip(features, weights)), d(0.0)) / d(norm)
    group = Window.partitionBy("jet_id")
    ranked = nodes.select("jet_id", "idx", *(c.alias(f) for f, c in clean.items()), along.alias("_s"))
    ranked = ranked.withColumn("_r", F.row_number().over(group.orderBy(F.desc("_s"), "idx"))).withColumn("_n", F.count(F.lit(1)).over(group))
    kept = ranked.where(F.col("_r") <= F.ceil(d(ratio) * F.col("_n"))).withColumn("score", F.tanh("_s"))
    for end in ("center", "neighbor"):
        edges = edges.join(kept.select("jet_id", F.col("idx").alias(end)), ["jet_id", end], "left_semi")
    return kept.select("jet_id", "idx", *((F.col(f) * F.col("score")).alias(f) for f in features), "score"), edges
