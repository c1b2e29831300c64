"""Connected components: union-find inside tasks, then star contraction between them.

Each task first reduces its edges to a forest by union-find. Then every round makes, by grouped minima and equi-joins,
the large stars and the small stars of what is left (two map-reduce steps whose rounds grow with the logarithm of
the largest component), until every node hangs under the smallest of its component. Minima are written before
they are joined back, so that both sides of the join are exchanged and adaptive execution can split a hot centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import materialise, release

_FLUSH = 400_000


class UnionFind:
    """Sets of numbers; a set is named by its smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: of every task's edges, each node and the smallest it is joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = UnionFind(), 0

        def out() -> pa.RecordBatch:
            pairs = np.array([(x, found.find(x)) for x in list(found.parent)], np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                found.union(a, b)
            seen += batch.num_rows
            if seen >= _FLUSH:
                yield out()
                found, seen = UnionFind(), 0
        yield out()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of all nodes of the undirected edges (u long, v long) but the smallest of each component."""
    spark = edges.sparkSession
    e = materialise(_forest(edges).distinct(), label)
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct(), label)
        release(spark)
