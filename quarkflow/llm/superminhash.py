"""Near-duplicates by SuperMinHash signatures, banding, verification on full shingle sets, and union-find grouping.

Every element draws a random permutation of the registers step by step; in step j it offers j plus a fraction to
the register that its permutation names, and a register keeps the least offer. Offers only rise, so a document is done
when all its registers lie below the next step; with more elements than registers that is after a few steps.

Equal sets are one class and go on as one row, under the smallest id. Classes that agree in a band meet that band's
smallest member; pairs that their sketches (a byte a register) don't rule out are verified on the full sets of both texts;
components of the verified links follow. A band in which several components are left still holds pairs that were not
looked at: those across components are compared in tiles of bounded size, first by sketches alone, which leaves the
members that have an undecided partner, then those members with their texts by full sets, and only links come out. So no
linked pair that shares a band is left out, whatever the size of a bucket (a pair at the threshold is ruled out by five
standard deviations of its sketch at least), and pairs are not listed.

Defined results: null and empty texts and texts without a word have no shingle and link with nothing (they are their
own component); a text of fewer words than a shingle has one shingle, all its words. Rows with a null id link with
nothing: component null, kept. Rows that repeat an id are one node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import map_batches, materialise, mix64, release
from quarkflow.llm.components import UnionFind, components

REGISTERS = 128
#: A pair at the threshold may share no band with at most this probability.
_MISS = 1e-6
_ODD = (mix64(np.arange(100, 164, dtype=np.uint64)) | np.uint64(1)).astype(np.uint64)
#: What step j adds to an element before it is mixed.
_STEPS = mix64(np.arange(1000, 1000 + 65_536, dtype=np.uint64))
_CHUNK = 32_768


class Words(dict):
    """64-bit hashes of words, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_words = Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles. Words: ASCII white space apart, A-Z in lower case."""
    words = (text or "").encode().lower().split()  # on bytes, both go by ASCII alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_words) > 300_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < k:
        return mix64((h * _ODD[:n]).sum(keepdims=True) + _ODD[n : n + 1] * _ODD[63:])
    total = h[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        total = total + h[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mix64(total))


def superminhash(elements: np.ndarray, docs: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x m) of elements (uint64) that belong to docs (numbers from 0)."""
    h = np.full((n_docs, m), np.inf)
    flat = h.reshape(-1)
    for at in range(0, len(elements), _CHUNK):
        e, d = elements[at : at + _CHUNK], docs[at : at + _CHUNK]
        p = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
        for j in range(m):
            r = mix64(e + _STEPS[j])
            k = j + ((r & np.uint64(0xFFFFFF)) % np.uint64(m - j)).astype(np.int64)
            rows = np.arange(len(e))
            here = p[rows, k]
            p[rows, k] = p[:, j]
            p[:, j] = here
            np.minimum.at(flat, d * m + here, j + (r >> np.uint64(24)) / float(1 << 40))
            # A document goes on if a register could still get less than it has.
            on = np.zeros(n_docs, bool)
            first, last = d[0], d[-1]
            on[first : last + 1] = h[first : last + 1].max(axis=1) > j + 1
            more = on[d]
            if not more.any():
                break
            if not more.all():
                e, d, p = e[more], d[more], p[more]
    return h


def bands_for(percent: int) -> int:
    """The number of bands with the most registers in each that a pair of similarity percent / 100 shares none of with probability _MISS at most (single registers if none do)."""
    for rows in range(REGISTERS // 2, 1, -1):
        bands = REGISTERS // rows
        if REGISTERS // bands == rows and (1 - (percent / 100) ** rows) ** bands <= _MISS:
            return bands
    return REGISTERS


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per document and band; the band's number is part of it."""
    bits = signatures.view(np.uint64)
    rows = signatures.shape[1] // bands
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(signatures), b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            acc = mix64(acc ^ bits[:, i])
        out[:, b] = acc
    return out


def sign(df: DataFrame, id_col: str, text_col: str, k: int, n_bands: int) -> DataFrame:
    """(id, n_shingles, digest, bands, sketch) of every row; the last three are null without shingles."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t.as_py(), k) for t in batch.column("text")]
            bands, sketch = [None] * len(sets), [None] * len(sets)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            filled = [i for i, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(filled):  # groups of documents of a bounded number of elements
                to, held = at, 0
                while to < len(filled) and (to == at or held + len(sets[filled[to]]) <= 8 * _CHUNK):
                    held += len(sets[filled[to]])
                    to += 1
                own = filled[at:to]
                sig = superminhash(np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), [len(sets[i]) for i in own]), len(own))
                hashed, low = band_hashes(sig, n_bands).view(np.int64), (mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
                for x, i in enumerate(own):
                    bands[i], sketch[i] = hashed[x], low[x].tobytes()
                at = to
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "n_shingles", "digest", "bands", "sketch"],
            )

        return work

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), make, "id long, n_shingles long, digest binary, bands array<bigint>, sketch binary")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts' sets have 100 * intersection >= percent * union."""
    # Sort-merge joins at every size: texts grow with the input.
    sides = [texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")).hint("merge") for x in ("u", "v")]
    rows = pairs.join(sides[0], "u").join(sides[1], "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, np.ndarray] = OrderedDict()

        def set_of(text: str) -> np.ndarray:
            if (s := kept.get(text)) is None:
                s = kept[text] = shingles(text, k)
                if len(kept) > 200:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(text)
            return s

        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v"))):
                a, b = set_of(a), set_of(b)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def linked(a: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of sets have 100 * intersection >= percent * union with a."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(sets), bool)
    for i in np.flatnonzero((100 * np.minimum(sizes, len(a)) >= percent * np.maximum(sizes, len(a))) & (sizes > 0)):
        both = np.count_nonzero(a[np.minimum(np.searchsorted(a, sets[i]), len(a) - 1)] == sets[i])
        out[i] = 100 * both >= percent * (len(a) + sizes[i] - both)
    return out


def least_agreement(percent: int) -> int:
    """Registers that agree in the sketches of a pair at the threshold, less five standard deviations."""
    j = percent / 100
    return int(REGISTERS * (j - 5 * math.sqrt(j * (1 - j) / REGISTERS)))


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches (id, sketch) don't rule the threshold out: texts are fetched for these alone."""
    sides = [sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}")).hint("merge") for x in ("u", "v")]
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sketch_u", "sketch_v"))
            at = pa.array(np.flatnonzero(np.count_nonzero(a == b, axis=1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], names=["u", "v"])

    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "sketch_u", "sketch_v").mapInArrow(run, "u long, v long")


def _tiles(opened: DataFrame, columns: tuple[str, ...], block: int, work: Callable[[list[tuple], list[tuple]], Iterator[pa.RecordBatch]], output: str) -> DataFrame:
    """work(those who ask, those who are seen) for each tile of some `block` by `block` members of a band.

    opened: (band, id, component, main, pivot, ...); main is the pivot's component, whose pairs with the pivot are known.
    The members outside main ask all members but the pivot.
    """
    sizes = materialise(
        opened.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rows"), F.ceil(F.count_if(F.col("component") != F.col("main")) / block).cast("int").alias("asks")), "tiles"
    )
    cut = opened.join(sizes, "band")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = cut.where("component <> main").select("band", own("asks").alias("ask"), every("rows").alias("row"), F.lit(True).alias("asking"), *columns)
    seen = cut.where("id <> pivot and asks > 0").select("band", every("asks").alias("ask"), own("rows").alias("row"), F.lit(False).alias("asking"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            rows = [r[2:] for r in held if not r[1]]
            if rows and len(rows) < len(held):
                yield from work([(r[0], *r[2:]) for r in held if r[1]], [(held[0][0], *r) for r in rows])

        for batch in batches:
            for band, ask, row, *rest in zip(*(batch.column(c).to_pylist() for c in ("band", "ask", "row", "asking", *columns))):
                if (band, ask, row) != now and held:
                    yield from out()
                    held = []
                now = (band, ask, row)
                held.append((band, *rest))
        if held:
            yield from out()

    parts = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = asks.unionByName(seen).repartition(parts, "band", "ask", "row").sortWithinPartitions("band", "ask", "row")
    return tiles.mapInArrow(run, output)


def _near(one: tuple, ids: np.ndarray, own: np.ndarray, main: np.ndarray, sketches: np.ndarray, least: int) -> np.ndarray:
    """Which of the seen members (band, id, component, main, sketch, ...) one that asks has to be compared with."""
    _, i, c, _, sketch = one[:5]
    return (own != c) & ((own == main) | (i < ids)) & (np.count_nonzero(sketches == np.frombuffer(sketch, np.uint8), axis=1) >= least)


def _seen(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return *(np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3)), np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)


def undecided(opened: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """(band, id): the members that have a partner in another component which the sketches don't rule out, no pairs. opened: without texts."""
    least = least_agreement(percent)

    def work(asks: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen = _seen(rows)
        ids, met = [], np.zeros(len(rows), bool)
        for one in asks:
            near = _near(one, *seen, least)
            if near.any():
                ids.append(one[1])
                met |= near
        ids += seen[0][met].tolist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["band", "id"])

    return _tiles(opened, ("id", "component", "main", "sketch"), block, work, "band long, id long").distinct()


def across(opened: DataFrame, k: int, percent: int, block: int = 512) -> DataFrame:
    """Links (u, v) between members of a band that lie in different components. opened: as for undecided(), with texts.

    Sketches that rule the threshold out are passed over, the rest is compared on the full sets. Tiles put out links alone, and
    no more than join the tile's members.
    """
    least = least_agreement(percent)

    def work(asks: list[tuple], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen = _seen(rows)
        ids, own = seen[0], seen[1]
        sets: list[np.ndarray | None] = [None] * len(rows)
        joined = UnionFind()
        us, vs = [], []
        for one in asks:
            near = _near(one, *seen, least)
            if not near.any():
                continue
            _, i, c, _, _, text = one
            a = shingles(text, k)
            for x in np.flatnonzero(near).tolist():
                if joined.find(c) == joined.find(int(own[x])):
                    continue
                if sets[x] is None:
                    sets[x] = shingles(rows[x][5], k)
                if linked(a, [sets[x]], percent)[0]:
                    joined.union(c, int(own[x]))
                    us.append(max(i, int(ids[x])))
                    vs.append(min(i, int(ids[x])))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return _tiles(opened, ("id", "component", "main", "sketch", "text"), block, work, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Links: k-word shingle sets with 100 * intersection >= percent * union."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(sign(df, id_col, text_col, k, bands_for(percent)), "signed")
    full = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = materialise(full.groupBy("digest").agg(F.min(F.struct("id", "bands", "sketch")).alias("c")).select("digest", "c.*"), "classes")
    members = classes.select("id", F.explode("bands").alias("band"))
    pivots = materialise(members.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "pivot"), "pivots")
    shared = materialise(members.join(pivots, "band").select("band", "id", "pivot"), "shared")
    sketches = classes.select("id", "sketch")
    pairs = shared.where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct()
    pairs = materialise(likely(pairs, sketches, percent), "pairs")
    # Only texts that the sketches can't decide on go on.
    of = lambda ids: materialise(texts.join(ids.distinct().hint("merge"), "id", "left_semi"), "near")
    links = materialise(verify(pairs, of(pairs.select(F.explode(F.array("u", "v")).alias("id"))), k, percent), "links")
    release(spark)
    joined = components(links)
    # Bands in which more than one component is left: pairs across components.
    where = materialise(shared.join(joined.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"), "pivot"), "where")
    open_bands = materialise(where.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"), "open")
    main = where.where("id = pivot").select("band", F.col("component").alias("main"))
    opened = materialise(where.join(open_bands, "band", "left_semi").join(main, "band").join(sketches, "id"), "opened")
    left = materialise(undecided(opened, percent), "undecided")
    release(spark)
    opened = materialise(opened.join(left, ["band", "id"], "left_semi").join(of(left.select("id")).hint("merge"), "id"), "opened")
    links = links.unionByName(materialise(across(opened, k, percent).distinct(), "links"))
    release(spark)
    joined = components(links)
    named = materialise(classes.select("id", "digest").join(joined.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "named")
    out = signed.join(named.hint("merge"), "digest", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: DuckDB's form for op6: three words, 85 percent.
ORACLE = """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3
        UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
    c AS (SELECT node, min(seen) AS m FROM r GROUP BY node)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(c.m, d.doc_id), d.doc_id) AS component_id, coalesce(c.m, d.doc_id) >= d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""
