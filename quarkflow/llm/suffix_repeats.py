"""Repeated passages by an enhanced suffix array's common-prefix intervals.

enhanced_suffix_array() sorts suffixes and takes the common prefixes of neighbours; repeat_groups() scans those with a
stack, which visits the interval tree bottom-up, and puts out every interval of the least length whose occurrences
differ in the byte before them: the maximal repeats, each with all its occurrences.

To do this for a corpus, equal strings must meet in one task, and only those. Every string of `length` bytes holds one
anchor: the GRAM bytes of least hash in it (the leftmost of equals). Neighbouring strings share anchors, so a document is
cut into runs of start places with one anchor, some 14 places each. A run travels as a few bytes: hash of the anchor,
80-bit hash of its whole span, document, place. Where the hashes of anchor and span agree (128 bits in all), the runs are
one string, and only that of the smallest document stays in question; the others' spans are repeats as they stand. Runs of one anchor with different
spans overlap in part: their spans (at most 76 bytes) are fetched from the texts and go through the suffix array, one
per task for all its anchors, and the repeat groups say which bytes are repeated. Anchors that very many spans share
(found on a hash sample of documents) are dealt out by span instead, and their strings are compared by grouped minima
of 128-bit digests, so that no task holds a group of unbounded size.

Defined results: a null text is empty; texts under `length` bytes lose nothing. Rows with a null id are left alone and
are no earlier document of others. Rows that repeat an id are no earlier document of each other; each loses what
its own text shares with smaller ids. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.llm.common import map_batches, materialise, mix64, release, schema_of

LENGTH, GRAM = 50, 24
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(5000))
_ODD = mix64(np.arange(6000, 6064, dtype=np.uint64)) | np.uint64(1)
_POS = np.uint64((1 << 24) - 1)
#: Bytes handled at once; a longer text is cut, the parts overlapping by LENGTH - 1.
_GROUP, _PART = 1 << 17, 1 << 23


# --- the suffix array and its interval tree -----------------------------------------------------------------------


def enhanced_suffix_array(texts: list[bytes], starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of texts[owner[i]] from starts[i]; lcp[i] is that of suffixes order[i - 1] and order[i], lcp[0] 0.

    Suffixes are compared over their whole length (texts of one call should be of similar, small size: the sort works on
    8-byte words of all suffixes at once).
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = sizes[owner] - starts
    width = -(-int(left.max()) // 8) * 8
    data = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[base[owner] + starts]
    rows[np.arange(width) >= left[:, None]] = 0
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((left, *words.T[::-1]))
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return order, np.concatenate([[0], np.minimum(common, np.minimum(left[order[1:]], left[order[:-1]]))]).astype(np.int64)


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least `least` bytes, children before parents, by a stack scan."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            yield size, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences as suffix numbers) of the maximal repeats. before: the byte before each suffix, or a negative number where there is none, which differs from all others."""
    inside = np.concatenate([lcp >= least, [False]])
    firsts = np.flatnonzero(~inside[:-1] & inside[1:])
    lasts = np.flatnonzero(inside[:-1] & ~inside[1:])
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        for size, i, j in intervals([0, *lcp[a + 1 : b + 1].tolist()], least):
            occurrences = order[a + i : a + j + 1]
            left = before[occurrences]
            if left[0] < 0 or (left != left[0]).any():
                yield size, occurrences


# --- anchors and runs ---------------------------------------------------------------------------------------------


@dataclass
class Runs:
    """Runs of start places with one anchor: hashes of anchor (48 bits) and span (64 and 16 more), document, first place, number of places."""

    anchor: np.ndarray
    span: np.ndarray
    more: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.anchor[at], self.span[at], self.more[at], self.doc[at], self.start[at], self.count[at])

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "span", "more", "doc", "start", "count")))

    def pack(self) -> bytes:
        """Columns byte by byte, compressed."""
        step = np.diff(self.anchor, prepend=np.uint64(0))
        columns = [step, self.span, self.more, self.doc, self.start.astype(np.uint32), self.count.astype(np.uint8)]
        raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
        return struct.pack("<I", len(step)) + zstandard.ZstdCompressor(level=1).compress(raw)

    @staticmethod
    def unpack(blob: bytes) -> Runs:
        (n,) = struct.unpack_from("<I", blob)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
        out, at = [], 0
        for kind in (np.uint64, np.uint64, np.uint16, np.int64, np.uint32, np.uint8):
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
            at += n * width
        return Runs(np.cumsum(out[0], dtype=np.uint64), *out[1:4], out[4].astype(np.int64), out[5].astype(np.int64))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of strings of 2 * size bytes from those of size bytes."""
    if len(h) <= size:
        return h[:0]
    out = h[:-size] * _ODD[size] + h[size:]
    out ^= out >> np.uint64(29)
    return out


def runs_of(pieces: list[tuple[int, int, bytes]]) -> Runs:
    """Runs of (document, place of the first byte, bytes) pieces."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    n = len(data)
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    number = np.repeat(np.arange(len(pieces)), sizes)
    h = _BYTE[data]
    for size in (1, 2, 4, 8):
        h = _grams(h, size)
    wide = _grams(h, 16)
    if GRAM > 16:
        h = _grams(h, GRAM - 16)
    key = h * _ODD[40]
    key ^= key >> np.uint64(32)
    key *= _ODD[41]
    key = (key & ~_POS) | np.arange(len(key), dtype=np.uint64)
    windows = LENGTH - GRAM + 1
    size = 1
    while 2 * size <= windows:  # minima of 2, 4, ... 32 neighbours
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if windows > size:
        key = np.minimum(key[: len(key) - (windows - size)], key[windows - size :])
    where = (key & _POS).astype(np.int64)
    inside = number[: n - LENGTH + 1] == number[LENGTH - 1 :]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (where[1:] != where[:-1])
    at = np.flatnonzero(begins)
    count = np.bincount(np.cumsum(begins)[inside], minlength=len(at) + 1)[1:]
    span = count + (LENGTH - 1)
    ends = wide[at], wide[at + (span - 32) // 2], wide[at + span - 32]  # three strings of 32 bytes cover a span
    hashed, more = (mix64(ends[0] * _ODD[x] + ends[1] * _ODD[x + 1] + ends[2] * _ODD[x + 2] + span.astype(np.uint64)) for x in (50, 55))
    piece = number[at]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids, places = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    return Runs(h[where[at]] & ~np.uint64(0xFFFF), hashed, (more >> np.uint64(48)).astype(np.uint16), ids[piece], at - first[piece] + places[piece], count)


def pieces_of(doc: int, text: bytes) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, max(1, len(text) - LENGTH + 1), _PART):
        if len(piece := text[at : at + _PART + LENGTH - 1]) >= LENGTH:
            yield doc, at, piece


def _batch_runs(batch: pa.RecordBatch) -> Iterator[Runs]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
        text = (text.as_py() or "").encode()
        if doc is None or len(text) < LENGTH:
            continue
        for piece in pieces_of(doc, text):
            held.append(piece)
            size += len(piece[2])
            if size >= _GROUP:
                yield runs_of(held)
                held, size = [], 0
    if held:
        yield runs_of(held)


def _classes(r: Runs) -> tuple[Runs, np.ndarray, np.ndarray]:
    """(runs sorted by anchor, span and document; number of each run's class; first place of each class)."""
    r = r.take(np.lexsort((r.doc, r.more, r.span, r.anchor)))
    new = np.ones(len(r.anchor), bool)
    new[1:] = (r.anchor[1:] != r.anchor[:-1]) | (r.span[1:] != r.span[:-1]) | (r.more[1:] != r.more[:-1])
    return r, np.cumsum(new) - 1, np.flatnonzero(new)


def _ahead(r: Runs, shift: int) -> tuple[Runs, Runs]:
    """(runs with a smaller document of the same class among r, the others, by anchor)."""
    r = r.take(np.argsort(r.anchor, kind="stable"))
    same = r.anchor[1:] == r.anchor[:-1]
    twice = np.zeros(len(r.anchor), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some, number, first = _classes(r.take(twice))
    later = some.doc >> shift > some.doc[first][number] >> shift
    rest = Runs.join([r.take(~twice), some.take(~later)])
    return some.take(later), rest.take(np.argsort(rest.anchor, kind="stable"))


_FOUND = "doc long, place long, count int, anchor long, kind int"
_SPAN, _REF, _HOT = 0, 1, 2


def _found(r: Runs, kind: int | np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(r.doc), kind, np.int32) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays(
        [pa.array(r.doc), pa.array(r.start.astype(np.int64)), pa.array(r.count.astype(np.int32)), pa.array(r.anchor.view(np.int64)), pa.array(kinds)], names=["doc", "place", "count", "anchor", "kind"]
    )


def hot_anchors(docs: DataFrame, sample: int, least: int, limit: int = 100_000) -> np.ndarray:
    """Anchors of which a sample (one document in `sample`, by a hash of the id) lets at least `least` runs expect; at most `limit`, the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _batch_runs(batch):
                yield pa.RecordBatch.from_arrays([pa.array(r.anchor.view(np.int64))], names=["anchor"])

    drawn = docs.where(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).mapInArrow(run, "anchor long")
    rows = drawn.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, least // sample)).orderBy(F.desc("n"), "anchor").limit(limit).collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def find_runs(docs: DataFrame, parts: int, hot: np.ndarray, shift: int = 0, flush: int = 600_000) -> DataFrame:
    """(doc, place, count, anchor, kind) of runs: kind 0 repeated as a whole, 1 to be compared with others of its anchor, 2 likewise with a hot anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most hot_anchors()' limit

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            later, rest = _ahead(Runs.join(held), shift)
            key = rest.anchor.copy()
            warm = _is_in(key, shared.value)
            key[warm] = mix64(key[warm] + rest.span[warm])  # by span too
            part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rest, part = rest.take(order), part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, 0, rest.take(slice(cuts[p], cuts[p + 1])).pack()) for p in range(parts) if cuts[p] < cuts[p + 1]]
            # What is known already goes along, a share to each task.
            share = -(-len(later.doc) // parts) or 1
            rows += [(int(later.anchor[i] % np.uint64(parts)), 1, later.take(slice(i, i + max(share, 4096))).pack()) for i in range(0, len(later.doc), max(share, 4096))]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "known", "blob"])

        for batch in batches:
            for r in _batch_runs(batch):
                held.append(r)
                size += len(r.doc)
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        now = -1

        def out() -> Iterator[pa.RecordBatch]:
            r, number, first = _classes(Runs.join(held))
            later = r.doc >> shift > r.doc[first][number] >> shift
            yield _found(r.take(later), _SPAN)
            # Classes of one anchor with different smallest documents: their smallest members are compared.
            heads = r.take(first)
            starts = np.flatnonzero(np.concatenate([[True], heads.anchor[1:] != heads.anchor[:-1]]))
            lo, hi = np.minimum.reduceat(heads.doc, starts), np.maximum.reduceat(heads.doc, starts)
            sizes = np.diff(np.append(starts, len(first)))
            warm = _is_in(r.anchor, shared.value)
            ask = ~later & (warm | np.repeat(lo >> shift != hi >> shift, sizes)[number])
            yield _found(r.take(ask), np.where(warm[ask], _HOT, _REF).astype(np.int32))

        for batch in batches:
            for part, known, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "known", "blob"))):
                if known:
                    yield _found(Runs.unpack(blob), _SPAN)
                    continue
                if part != now and held:
                    yield from out()
                    held = []
                now = part
                held.append(Runs.unpack(blob))
        if held:
            yield from out()

    dealt = docs.mapInArrow(deal, "part int, known int, blob binary").repartition(max(1, parts // 4), "part").sortWithinPartitions("known", "part")
    return dealt.mapInArrow(meet, _FOUND)


def _contexts(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, kind, doc, place, count, span) with the bytes of each run's span."""
    by_doc = refs.groupBy("doc").agg(F.collect_list(F.struct("place", "count", "anchor", "kind")).alias("refs"))
    # A sort-merge join at every size: texts grow with the input.
    joined = docs.join(by_doc.hint("merge"), docs["id"] == by_doc["doc"]).select("doc", "text", "refs")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: list[tuple] = []
            for doc, text, refs in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "refs"))):
                text = (text or "").encode()
                for r in refs:
                    span = text[r["place"] : r["place"] + r["count"] + LENGTH - 1]
                    if len(span) == r["count"] + LENGTH - 1:
                        out.append((r["anchor"], r["kind"], doc, r["place"], r["count"], span))
            if not out:
                return None
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["anchor", "kind", "doc", "place", "count", "span"])

        return work

    return map_batches(joined, make, "anchor long, kind int, doc long, place long, count int, span binary")


def repeats_among(docs: list[int], places: list[int], spans: list[bytes], shift: int = 0) -> Iterator[tuple[int, int, int]]:
    """(document, first byte, end) of what spans share with spans of smaller documents, by repeat groups."""
    counts = np.array([len(s) - LENGTH + 1 for s in spans], np.int64)
    owner = np.repeat(np.arange(len(spans)), counts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, lcp = enhanced_suffix_array(spans, starts, owner)
    data = np.frombuffer(b"".join(spans), np.uint8)
    base = np.cumsum([0, *map(len, spans)])[:-1]
    before = np.where(starts > 0, data[base[owner] + np.maximum(starts, 1) - 1].astype(np.int64), -1)
    doc, place = np.array(docs, np.int64)[owner], np.array(places, np.int64)[owner] + starts
    for size, occurrences in repeat_groups(order, lcp, before, LENGTH):
        own = doc[occurrences] >> shift
        least = own.min()
        for i in occurrences[own > least].tolist():
            yield int(doc[i]), int(place[i]), int(place[i]) + size


_SPANS = "doc long, first long, end long"
#: Bytes of spans that one suffix array takes; an anchor's spans are never parted.
_ARRAY = 1 << 20


def _array_spans(contexts: DataFrame, parts: int, shift: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        places: list[int] = []
        spans: list[bytes] = []
        size, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            found = list(repeats_among(docs, places, spans, shift))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc", "first", "end"])

        for batch in batches:
            for anchor, doc, place, span in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "place", "span"))):
                if size > _ARRAY and anchor != last:
                    yield from out()
                    docs, places, spans, size = [], [], [], 0
                docs.append(doc)
                places.append(place)
                spans.append(span)
                size += len(span)
                last = anchor
        if spans:
            yield from out()

    return contexts.select("anchor", "doc", "place", "span").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def _hot_spans(contexts: DataFrame, shift: int) -> DataFrame:
    """The same for hot anchors: strings of LENGTH bytes meet by digest, through grouped minima."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: list[tuple] = []
            for doc, place, count, span in zip(*(batch.column(c).to_pylist() for c in ("doc", "place", "count", "span"))):
                out += [(hashlib.blake2b(span[i : i + LENGTH], digest_size=16).digest(), doc, place + i) for i in range(count)]
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "doc", "first"])

        return work

    strings = map_batches(contexts, make, "digest binary, doc long, first long")
    least = materialise(strings.groupBy("digest").agg(F.shiftright(F.min("doc"), shift).alias("least"), F.shiftright(F.max("doc"), shift).alias("most")).where("least < most").select("digest", "least"), "least")
    return strings.join(least, "digest").where(F.shiftright("doc", shift) > F.col("least")).select("doc", "first", (F.col("first") + LENGTH).alias("end"))


def repeated_spans(df: DataFrame, id_col: str, text_col: str, sample: int = 64, hot: int = 20_000, shift: int = 0) -> DataFrame:
    """(doc, spans array of (first, end)): bytes of each document that lie in a LENGTH-byte string which also starts in a document of smaller id. Of ids, the last `shift` bits don't make one smaller."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = hot_anchors(docs, sample, hot)
    found = materialise(find_runs(docs, parts, table, shift), "runs")
    release(spark)
    contexts = materialise(_contexts(found.where(F.col("kind") > _SPAN), docs), "contexts")
    release(spark)
    spans = found.where(F.col("kind") == _SPAN).select("doc", F.col("place").alias("first"), (F.col("place") + F.col("count") + (LENGTH - 1)).alias("end"))
    spans = spans.unionByName(materialise(_array_spans(contexts.where(F.col("kind") == _REF), max(1, parts // 4), shift), "array"))
    if len(table):
        spans = spans.unionByName(materialise(_hot_spans(contexts.where(F.col("kind") == _HOT), shift), "hot"))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The union of spans within n bytes, as maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to the characters that lie wholly in them."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _outside(data: bytes, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    at = 0
    for a, b in spans:
        yield data[at:a]
        at = b
    yield data[at:]


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(docs with _key, shift): a number for each id and text, whose order without the last `shift` bits is that of the ids.

    Where no id has two texts it is the id. Otherwise ids are ranked (by a range partitioning and sums of its parts) and
    the texts of an id numbered, which takes a shuffle of the texts.
    """
    spark = docs.sparkSession
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h"))
    pairs = hashed.groupBy("_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    if pairs.where("lo <> hi").isEmpty():
        return docs.withColumn("_key", F.col(id_col)), 0
    ranked = materialise(pairs.select("_id").repartitionByRange("_id").sortWithinPartitions("_id").withColumn("_n", F.monotonically_increasing_id()), "ranked")
    base, bases = 0, []
    for p, n in sorted((r.p, r.n) for r in ranked.groupBy(F.shiftright("_n", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per part
        bases.append((p, base))
        base += n
    ranked = ranked.join(F.broadcast(spark.createDataFrame(bases, "p long, base long")), F.shiftright("_n", 33) == F.col("p"))
    ranked = ranked.select("_id", (F.col("base") + F.col("_n").bitwiseAND((1 << 33) - 1)).alias("_rank"))
    several = hashed.join(pairs.where("lo <> hi").select("_id"), "_id", "left_semi").distinct()
    several = several.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_h")) - 1)
    several = materialise(several, "several")
    shift = int(several.agg(F.max("_nth")).first()[0]).bit_length()
    if base << shift >= 1 << 62:
        raise ValueError("more ids and texts of one id than keys can tell apart")
    keyed = docs.withColumn("_id", F.col(id_col)).withColumn("_h", F.xxhash64(F.coalesce(text_col, F.lit("")))).join(ranked, "_id", "left").join(several, ["_id", "_h"], "left")
    return keyed.select(*docs.columns, (F.shiftleft("_rank", shift) + F.coalesce("_nth", F.lit(0))).alias("_key")), shift


def remove_repeats(df: DataFrame, id_col: str, text_col: str, *keep: Column, **options) -> DataFrame:
    """Per row: id, keep, n_bytes, n_removed, n_spans, kept_sha256 (all by bytes) and kept_text (without the characters that lie wholly in removed bytes)."""
    docs, shift = with_keys(df.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("_text")), id_col, "_text")
    spark = df.sparkSession
    spans = materialise(repeated_spans(docs, "_key", "_text", shift=shift, **options), "spans").withColumnRenamed("doc", "_doc")
    release(spark)
    names = docs.columns[:-2]
    joined = docs.join(spans.hint("merge"), docs["_key"] == spans["_doc"], "left").select(*names, "_text", "spans")
    more = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                gone = merged([(s["first"], s["end"]) for s in spans or ()], len(data))
                kept, left = b"".join(_outside(data, gone)), b"".join(_outside(data, whole_characters(data, gone)))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), None if text is None else left.decode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=[*names, *(x.split()[0] for x in more.split(", "))])

        return work

    return map_batches(joined, make, schema_of(joined, names, more))


#: DuckDB's form for documents: all strings of 50 bytes.
ORACLE = """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
    s AS (SELECT doc_id, unnest(range(0, octet_length(h) - 49)) AS p, unnest(list_transform(range(0, octet_length(h) - 49), lambda i: array_slice(h, i + 1, i + 50))) AS t FROM d),
    f AS (SELECT t, min(doc_id) AS least FROM s GROUP BY t),
    c AS (SELECT doc_id, p FROM s JOIN f USING (t) WHERE least < doc_id),
    g AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
          FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c)),
    r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
    n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM r GROUP BY doc_id),
    k AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a)
          UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), max(octet_length(d.h)) FROM d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
    t AS (SELECT k.doc_id, string_agg(hex(array_slice(d.h, a + 1, b)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
    SELECT d.doc_id, CAST(octet_length(d.h) AS BIGINT) AS n_bytes, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
