"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Neighbour lists start from random projections: for each of some tables the vectors are
sorted by a string of projection signs and compared in blocks of neighbours in that order (a dense spot is spread over
as many blocks as it needs). Then lists are refined: around every vector its neighbours and the vectors that it
is a neighbour of are compared with each other, and each keeps the best. A list that is full of links is saturated:
its size is doubled for the next round. Links (cosine >= threshold) are joined
to components, and inside a component all vectors are counted against each other in blocks, which completes lists
that a bounded size cut off and emits no pairs. Blocks hold vectors of like angle to the component's first vector: by the
triangle inequality some pairs of blocks can hold no link and some hold links only, and neither are compared. There are as many
tables as two lone vectors at the threshold need to share a block of one of them but for one time in ten thousand; so
their number grows with the table. An audit compares a bounded hash sample of vectors with all by brute force, half of it
from vectors without a known link, and estimates the share of linked vectors that have all of their links: by vector, so
that a dense group can't hide lone pairs. While it is too low, projections of another seed and further rounds follow. If
that doesn't help, the completion below takes in all vectors and is exact.

Lists of a bounded size can lose every link between two dense groups. Such a link has full lists of links at both ends
(any other list has room for it), so a completion looks at saturated vectors alone: each goes to the cell of a hub, a
vector of its list, and hubs of different components are compared in blocks; only cells that, by the triangle
inequality, may hold linked vectors are compared vector by vector. Vectors that are not saturated rely on their lists,
whose recall the audit states (audit_recall), unless the completion took in all.

Defined results: vectors that are null, of length zero, or with null or non-finite components link with nothing (own
component); vectors of different dimensions have no link. Rows with a null id likewise, with component null and kept
true. Rows that repeat an id count as vectors of their own that share a component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.llm.common import materialise, release
from quarkflow.llm.components import components

_PAIR = "u long, v long, sim double"


#: What the triangle inequality is given for rounding, in radians.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _by_dimension(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension."""
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([vecs[i] for i in at]), np.float64).reshape(len(at), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the rows of a and b."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    return a @ b.T / na[:, None] / nb[None, :]


def _angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between the rows of x and those of y in the same place."""
    return np.arccos(np.clip((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), -1, 1))


def classes_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(every row's id and class, null where it can't link; classes (id, vec, n, first) of equal vectors: a number, the rows, their smallest id).

    A vector is scaled by a power of two, exactly, so that its largest component is near 1.
    """
    raw = F.col(vec_col).cast("array<double>")
    whole = raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.when(whole & F.col(id_col).isNotNull(), raw).alias("vec"))

    def scaled(v: list[float]) -> bytes:
        x = np.array(v, np.float64) + 0.0  # -0.0 and 0.0 are one vector
        return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [None if v is None else scaled(v) for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(vecs, pa.binary())], names=["row_id", "vec"])

    rows = materialise(rows.mapInArrow(run, "row_id long, vec binary"), "vectors")
    groups = rows.where("vec is not null").groupBy("vec").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialise(groups.select(F.monotonically_increasing_id().alias("id"), "vec", "n", "first"), "vector-classes")
    return materialise(rows.join(classes.select("vec", "id"), "vec", "left").select("row_id", "id"), "rows"), classes


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row of sims (square, by ids) its k best others, as (u, v, sim)."""
    n = len(ids)
    if n < 2:
        return
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    u = np.repeat(ids, k)
    yield u, ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel()


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for u, v, sim in found:
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(sim)], names=["u", "v", "sim"])


def project(vectors: DataFrame, k: int, tables: int, seed: int, block: int = 256) -> DataFrame:
    """(u, v, sim): the k best of each vector in its block of each projection table."""
    bits = 48

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_dimension(batch.column("vec").to_pylist()):
                own = batch.take(pa.array(at))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t]).standard_normal((x.shape[1], bits))
                    sign = (x @ planes > 0).astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    same = [pa.array(np.full(len(x), v, np.int32)) for v in (x.shape[1], t)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(sign), own.column("id"), own.column("vec")], names=["d", "t", "key", "id", "vec"])

    dealt = materialise(vectors.select("id", "vec").mapInArrow(keys, "d int, t int, key long, id long, vec binary"), "projected")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            # Dimensions come in order: what is held of another one is done.
            for at, x in _by_dimension(batch.column("vec").to_pylist()):
                if len(ids) and vecs.shape[1] != x.shape[1]:
                    yield from _pairs(_best(cosines(vecs, vecs), ids, k))
                    ids = ids[:0]
                own = batch.column("id").to_numpy()[at]
                ids, vecs = np.concatenate([ids, own]), np.concatenate([vecs, x]) if len(ids) else x
                while len(ids) >= 2 * block:
                    yield from _pairs(_best(cosines(vecs[:block], vecs[:block]), ids[:block], k))
                    ids, vecs = ids[block:], vecs[block:]
        if len(ids):
            yield from _pairs(_best(cosines(vecs, vecs), ids, k))

    ranged = dealt.repartitionByRange("d", "t", "key", "id").sortWithinPartitions("d", "t", "key", "id").select("id", "vec")
    return ranged.mapInArrow(compare, _PAIR).where("u <> v")


def _keep(pairs: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """Each u's best: k, or as many as sizes (id, k) says."""
    best = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    if sizes is None:
        return ranked.where(F.col("r") <= k).drop("r")
    return ranked.join(sizes, ranked["u"] == sizes["id"], "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).select("u", "v", "sim")


def refine(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(u, v, sim) of neighbours' neighbours: around each vector, its neighbours and those it is a neighbour of are compared."""
    around = lists.select("u", "v", "sim").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).distinct()
    around = around.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= 2 * k).select("u", "v")
    rows = around.join(vectors.select(F.col("id").alias("v"), "vec"), "v").select("u", "v", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            u, v, vecs = table.column("u").to_numpy(), table.column("v").to_numpy(), table.column("vec").to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):  # neighbours are of one dimension
                x = np.frombuffer(b"".join(vecs[a:b]), np.float64).reshape(b - a, -1)
                out += _best(cosines(x, x), v[a:b], 2)
            if out:
                yield tuple(np.concatenate(c) for c in zip(*out))

        for batch in batches:
            held.append(batch)
            last = batch.column("u")[-1].as_py()
            if held[0].column("u")[0].as_py() != last:
                table = pa.Table.from_batches(held)
                cut = int(np.searchsorted(table.column("u").to_numpy(), last))
                yield from _pairs(groups(table.slice(0, cut)))
                held = table.slice(cut).to_batches()
        if held:
            yield from _pairs(groups(pa.Table.from_batches(held)))

    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(run, _PAIR)


def tables_for(vectors: int, threshold: float, block: int = 256, missed: float = 1e-4) -> int:
    """Projection tables in which two lone vectors at the threshold share a block, but for a share `missed` of such pairs: blocks take as many signs as halve the vectors to their size."""
    signs = max(0.0, math.log2(max(vectors, 1) / block))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if together > 1 - missed else math.ceil(math.log(missed) / math.log(1 - together))


def audit(vectors: DataFrame, lists: DataFrame, named: DataFrame, threshold: float, queries: int) -> float:
    """Of the vectors with a true link, the share whose true links are all inside their component, estimated from at most `queries` vectors. 1 if none has a link.

    Vectors without a link in their list and others are drawn from apart, by hash, and count as many as they stand for.
    """
    spark = vectors.sparkSession
    known = lists.where(F.col("sim") >= threshold).select(F.col("u").alias("id")).distinct().withColumn("known", F.lit(1))
    strata = materialise(vectors.select("id", "vec").join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(0))), "strata")
    sizes = {r.known: r.n for r in strata.groupBy("known").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, share = [], {}
    for kind, n in sizes.items():
        rows = strata.where(F.col("known") == kind).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(queries // 2).select("id", "vec").collect()
        drawn += [(r.id, bytes(r.vec), n / len(rows)) for r in rows]
    if not drawn:
        return 1.0
    ids, share = np.array([d[0] for d in drawn]), {d[0]: d[2] for d in drawn}
    shared = spark.sparkContext.broadcast({x.shape[1]: (ids[at], x) for at, x in _by_dimension([d[1] for d in drawn])})
    block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                for at, y in _by_dimension(part.column("vec").to_pylist()):
                    if y.shape[1] in shared.value:
                        ids, x = shared.value[y.shape[1]]
                        own = part.column("id").to_numpy()[at]
                        sims = cosines(y, x)
                        i, q = np.nonzero((sims >= threshold) & (own[:, None] != ids[None, :]))
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[q]), pa.array(sims[i, q])], names=["u", "v", "sim"])

    links = vectors.select("id", "vec").mapInArrow(run, _PAIR)
    a, b = named.select(F.col("node").alias("u"), F.col("component").alias("cu")), named.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    kept = F.coalesce("cu", "u") == F.coalesce("cv", "v")
    by_vector = links.join(a, "u", "left").join(b, "v", "left").groupBy("v").agg(F.min(kept.cast("int")).alias("kept")).collect()  # a row per query at most
    whole = sum(share[r.v] for r in by_vector)
    return sum(share[r.v] * r.kept for r in by_vector) / whole if by_vector else 1.0


def _tiles(sides: DataFrame, output: str, work) -> DataFrame:
    """work(rows of side 0, rows of side 1) for each tile; sides: (tile columns a, b, side, id, component, vec, n). Rows are tuples (side, id, component, vec, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for a, b, *row in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "side", "id", "component", "vec", "n"))):
                if (a, b) != now and held:
                    yield from work([r for r in held if not r[0]], [r for r in held if r[0]])
                    held = []
                now = (a, b)
                held.append(tuple(row))
        if held:
            yield from work([r for r in held if not r[0]], [r for r in held if r[0]])

    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.select("a", "b", "side", "id", "component", "vec", "n").repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, output)


def _stack(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join([r[3] for r in rows]), np.float64).reshape(len(rows), -1)


def near_cells(heads: DataFrame, reach: float, share_bytes: int = 8 << 20, rows: int = 256) -> DataFrame:
    """(a, b): hubs of different components whose cells may hold vectors at most `reach` (an angle) apart. heads: (hub, component, radius, vec).

    A hash deals the hubs into shares of some share_bytes; each is broadcast in turn and meets its own and later shares.
    """
    spark = heads.sparkSession
    total = heads.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    shares = max(1, -(-total.n * (total.bytes or 0) // share_bytes))
    dealt = heads.withColumn("share", F.pmod(F.xxhash64("hub", F.lit(11)), F.lit(shares)))
    dealt = materialise(dealt, "shares")
    out = None
    for share in range(shares):
        drawn = dealt.where(F.col("share") == share).select("hub", "component", "radius", "vec").collect()  # some share_bytes
        if not drawn:
            continue
        hubs, components_, radii = (np.array([r[i] for r in drawn]) for i in range(3))
        shared = spark.sparkContext.broadcast({x.shape[1]: (hubs[at], components_[at], radii[at], x) for at, x in _by_dimension([bytes(r.vec) for r in drawn])})
        del drawn

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    own, component, radius = (part.column(c).to_numpy() for c in ("hub", "component", "radius"))
                    for at, x in _by_dimension(part.column("vec").to_pylist()):
                        if x.shape[1] in shared.value:
                            others, their, wide, y = shared.value[x.shape[1]]
                            least = np.cos(np.minimum(radius[at][:, None] + wide[None, :] + (reach + _SLACK), np.pi))
                            i, j = np.nonzero((cosines(x, y) >= least) & (component[at][:, None] != their[None, :]))
                            u, v = own[at][i], others[j]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

        found = materialise(dealt.where(F.col("share") >= share).select("hub", "component", "radius", "vec").mapInArrow(run, "a long, b long"), "near-cells")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.distinct() if out is not None else spark.createDataFrame([], "a long, b long")


def complete(lists: DataFrame, full: DataFrame | None, vectors: DataFrame, named: DataFrame, threshold: float, block: int = 512, **options) -> DataFrame:
    """(u, v): links between saturated vectors (full: id; None: all vectors) of different components, no more than join the vectors of a tile."""
    reach = float(np.arccos(threshold))
    near = lists.where(F.col("sim") >= threshold)
    near = near.join(full.select(F.col("id").alias("u")), "u", "left_semi") if full is not None else near.unionByName(vectors.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("sim")))
    cells = near.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
    cells = cells.select("id", F.least("id", "m").alias("hub")).join(vectors.select("id", "vec"), "id").join(vectors.select(F.col("id").alias("hub"), F.col("vec").alias("hub_vec")), "hub")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for (at, x), (_, y) in zip(*(_by_dimension(batch.column(c).to_pylist()) for c in ("vec", "hub_vec"))):
                out[at] = _angle(x, y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub"), pa.array(out), batch.column("vec")], names=["id", "hub", "angle", "vec"])

    cells = materialise(cells.select("id", "hub", "vec", "hub_vec").mapInArrow(angles, "id long, hub long, angle double, vec binary"), "cells")
    component = named.select(F.col("node").alias("hub"), "component")  # of a hub as of all of its cell
    heads = cells.groupBy("hub").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size")).join(component, "hub", "left").withColumn("component", F.coalesce("component", "hub"))
    heads = materialise(heads.join(vectors.select(F.col("id").alias("hub"), "vec"), "hub"), "heads")
    near = materialise(near_cells(heads, reach, **options), "near-cells")
    about = heads.select("hub", "component", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    both = near.join(about.select(F.col("hub").alias("a"), F.col("component").alias("ca"), F.col("blocks").alias("na")), "a")
    both = both.join(about.select(F.col("hub").alias("b"), F.col("component").alias("cb"), F.col("blocks").alias("nb")), "b")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = []
    for side, (x, n, other) in enumerate((("a", "na", "nb"), ("b", "nb", "na"))):
        met = both.join(cells.select(F.col("hub").alias(x), "id", "vec"), x)
        met = met.select("a", "b", F.lit(side).alias("side"), "id", F.col("cb" if side else "ca").alias("component"), "vec", F.lit(1).alias("n"), own(n).alias("own"), every(other).alias("other"))
        sides.append(met.select(F.struct("a", F.col("other" if side else "own").alias("i")).alias("a"), F.struct("b", F.col("own" if side else "other").alias("i")).alias("b"), "side", "id", "component", "vec", "n"))

    def links(first: list[tuple], second: list[tuple]) -> Iterator[pa.RecordBatch]:
        if first and second:
            i, j = np.nonzero(cosines(_stack(first), _stack(second)) >= threshold)
            if len(i):  # a cell is in one component: any link joins them
                yield pa.RecordBatch.from_arrays([pa.array([first[i[0]][1]], pa.int64()), pa.array([second[j[0]][1]], pa.int64())], names=["u", "v"])

    flat = sides[0].unionByName(sides[1]).withColumn("a", F.to_json("a")).withColumn("b", F.to_json("b"))
    return _tiles(flat, "u long, v long", links)


def count_links(vectors: DataFrame, named: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(id, links): per class, the rows of other classes of its component with cosine >= threshold.

    A component is cut into blocks of about `block` classes whose angles to its first vector are alike (to an eighth of the
    links' reach), and blocks meet unless their angles decide: too far apart, or so small that all are linked.
    """
    reach = float(np.arccos(threshold))
    component = named.select(F.col("node").alias("id"), "component")
    members = vectors.select("id", "vec", "n").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    first = vectors.select(F.col("id").alias("component"), F.col("vec").alias("first_vec"))
    members = members.join(materialise(sizes.select("component").join(first, "component"), "first"), "component")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for (at, x), (_, y) in zip(*(_by_dimension(batch.column(c).to_pylist()) for c in ("vec", "first_vec"))):
                out[at] = _angle(x, y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "component", "vec", "n")), pa.array(out)], names=["id", "component", "vec", "n", "angle"])

    members = members.select("id", "component", "vec", "n", "first_vec").mapInArrow(angles, "id long, component long, vec binary, n long, angle double")
    members = materialise(members.withColumn("ring", F.floor(F.col("angle") / (reach / 8)).cast("int")), "members")
    rings = materialise(members.groupBy("component", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "rings")
    cut = members.join(rings, ["component", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cut = materialise(cut.withColumn("block", F.col("ring") * F.lit(1 << 31) + F.col("part")).select("id", "component", "vec", "n", "angle", "block"), "blocks")
    blocks = materialise(cut.groupBy("component", "block").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("n").alias("rows")), "block-sizes")
    one = blocks.select("component", F.col("block").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("rows").alias("ra"))
    two = blocks.select("component", F.col("block").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("rows").alias("rb"))
    pairs = one.join(two, "component").where((F.col("a") <= F.col("b")) & (F.col("lb") - F.col("ha") <= reach + _SLACK))
    pairs = materialise(pairs.withColumn("sure", (F.col("a") < F.col("b")) & (F.col("ha") + F.col("hb") <= reach - _SLACK)), "block-pairs")
    sure = pairs.where("sure").select("component", F.inline(F.array(F.struct(F.col("a").alias("block"), F.col("rb").alias("more")), F.struct(F.col("b").alias("block"), F.col("ra").alias("more")))))
    known = cut.select("id", "component", "block").join(sure.groupBy("component", "block").agg(F.sum("more").alias("links")), ["component", "block"]).select("id", "links")
    asked = pairs.where("not sure").select("component", "a", "b")
    sides = cut.withColumnRenamed("block", "a").join(asked, ["component", "a"]).withColumn("side", F.lit(0))
    sides = sides.unionByName(cut.withColumnRenamed("block", "b").join(asked.where("a < b"), ["component", "b"]).withColumn("side", F.lit(1)))

    def count(first: list[tuple], second: list[tuple]) -> Iterator[pa.RecordBatch]:
        x, y = _stack(first), _stack(second or first)
        near = cosines(x, y) >= threshold
        if not second:
            np.fill_diagonal(near, False)
        out = [(first, near @ np.array([r[4] for r in second or first]))] + [(second, near.T @ np.array([r[4] for r in first]))] * bool(second)
        for rows, links in out:
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(links)], names=["id", "links"])

    flat = sides.withColumn("a", F.concat_ws(",", "component", "a")).withColumn("b", F.concat_ws(",", "component", "b"))
    return _tiles(flat, "id long, links long", count).unionByName(known).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, id_col: str, vec_col: str, threshold: float = 0.95, k: int = 8, max_k: int = 32, tables: int = 8, rounds: int = 2, attempts: int = 4, recall: float = 0.995, queries: int = 4000
) -> DataFrame:
    """Per row: id, n_links, component_id, kept, audit_recall (of the last audit). tables: of vectors that are written at a time."""
    spark = df.sparkSession
    rows, vectors = classes_of(df, id_col, vec_col)
    # Classes of rows that repeat an id share a component.
    shared = rows.where("id is not null").groupBy("row_id").agg(F.min("id").alias("lo"), F.collect_set("id").alias("ids")).where("size(ids) > 1")
    shared = materialise(shared.select(F.explode("ids").alias("u"), F.col("lo").alias("v")).where("u <> v"), "shared-ids")
    lists, sizes, found = None, None, 0.0
    named = None
    batches = -(-tables_for(vectors.count(), threshold) // tables)
    for attempt in range(attempts):
        for batch in range(batches):
            more = project(vectors, k, tables, attempt * batches + batch)
            lists = materialise(_keep(more if lists is None else more.unionByName(lists), sizes, k), "lists")
        for _ in range(rounds):
            lists = materialise(_keep(refine(lists, vectors, k).unionByName(lists), sizes, k), "lists")
            # A full list whose last neighbour is a link may lack others: it gets twice the room.
            room = lists.groupBy("u").agg(F.count(F.lit(1)).alias("held"), F.min("sim").alias("last")).where((F.col("last") >= threshold) & (F.col("held") >= k))
            sizes = materialise(room.select(F.col("u").alias("id"), F.least(F.col("held") * 2, F.lit(max_k)).cast("int").alias("k")), "room")
            release(spark)
        named = components(lists.where(F.col("sim") >= threshold).select("u", "v"), "vector-components")
        found = audit(vectors, lists, named, threshold, queries)
        if found >= recall:
            break
    # Lists that stay short of the recall are not relied on: the completion is then among all vectors.
    joins = materialise(complete(lists, sizes if found >= recall else None, vectors, named, threshold), "joins")
    if not joins.isEmpty():
        named = components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(joins), "vector-components")
        found = audit(vectors, lists, named, threshold, queries)
    links = count_links(vectors, named, threshold)
    if not shared.isEmpty():
        named = components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(shared), "vector-components")
    about = vectors.select("id", "n", "first").join(named.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    about = materialise(about.join(links, "id", "left").select("id", "component", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "about")
    least = materialise(about.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    about = about.join(least, "component").select("id", "n_links", "component_id")
    out = rows.join(about, "id", "left").select(
        F.col("row_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("row_id").isNotNull(), F.coalesce("component_id", "row_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("audit_recall", F.lit(found))


#: DuckDB's form for embeddings: all pairs. The audit finds all links where the components are right.
ORACLE = """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r AS (SELECT x AS node, x AS seen FROM l UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
    c AS (SELECT node, min(seen) AS m FROM r GROUP BY node),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept, CAST(1 AS DOUBLE) AS audit_recall
    FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.x = e.vec_id"""
