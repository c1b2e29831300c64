"""Weights of trained networks as versioned tables on shared storage.

A model's folder holds `last` and `best` apart, and in each a folder per version: Parquet rows (kind, config, name, shape,
values), a row per weight array, written by Spark. A version counts once Spark's committer has left _SUCCESS in it, so a
reader sees all of a version or none; a stopped write leaves a number that nobody reads and the next writer passes over.
Readers name the kind of network they expect: another one is an error, never a wrongly shaped model.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from quarkflow.operators.networks import KINDS, Network
from quarkflow.sources.sinks import _fs, exists, is_complete

_SCHEMA = "kind string, config string, about string, name string, shape array<int>, values array<double>"
TAGS = ("last", "best")


@dataclass
class Snapshot:
    """A network, its flat weights, what else is needed to go on or to score (arrays by name), and about: plain values."""

    network: Network
    weights: np.ndarray
    arrays: dict[str, np.ndarray]
    about: dict
    version: int = 0


def versions(spark: SparkSession, path: str, tag: str) -> list[tuple[int, bool]]:
    """(version, whether it is complete) in rising order."""
    folder = f"{path.rstrip('/')}/{_tag(tag)}"
    if not exists(spark, folder):
        return []
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [(v, is_complete(spark, f"{folder}/version={v}")) for v in found]


def _tag(tag: str) -> str:
    if tag not in TAGS:
        raise ValueError(f"a snapshot is one of {', '.join(TAGS)}")
    return tag


def save(spark: SparkSession, path: str, tag: str, snapshot: Snapshot) -> int:
    """Write the next version; returns its number. Weights are the driver's already, bounded by the network's size."""
    version = max((v for v, _ in versions(spark, path, tag)), default=0) + 1
    kind, config, about = type(snapshot.network).__name__, json.dumps(snapshot.network.config(), sort_keys=True), json.dumps(snapshot.about, sort_keys=True)
    named = {f"w.{n}": v.value for n, v in snapshot.network.weights(snapshot.weights).items()} | {f"a.{n}": np.asarray(v, float) for n, v in snapshot.arrays.items()}
    rows = [(kind, config, about, n, list(v.shape), v.ravel().tolist()) for n, v in named.items()]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(f"{path.rstrip('/')}/{tag}/version={version}")
    return version


def load(spark: SparkSession, path: str, tag: str = "best", kind: type[Network] | None = None, version: int | None = None) -> Snapshot:
    """The newest complete version, or the one asked for. A folder without one, another kind or arrays of other shapes are errors."""
    whole = [v for v, done in versions(spark, path, tag) if done and version in (None, v)]
    if not whole:
        raise FileNotFoundError(f"no complete {tag} version{'' if version is None else f' {version}'} in {path}")
    rows = spark.read.schema(_SCHEMA).parquet(f"{path.rstrip('/')}/{tag}/version={whole[-1]}").collect()
    found = rows[0]["kind"]
    if found not in KINDS or kind is not None and KINDS[found] is not kind:
        raise TypeError(f"{path} holds a model of kind {found}")
    network = KINDS[found](**json.loads(rows[0]["config"]))
    arrays = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in rows}
    shapes = network.shapes()
    if {n: arrays[f"w.{n}"].shape if f"w.{n}" in arrays else None for n in shapes} != shapes:
        raise TypeError(f"{path} holds arrays that are not those of its {found}")
    flat = np.concatenate([arrays[f"w.{n}"].ravel() for n in shapes])
    return Snapshot(network, flat, {n[2:]: v for n, v in arrays.items() if n.startswith("a.")}, json.loads(rows[0]["about"]), whole[-1])
