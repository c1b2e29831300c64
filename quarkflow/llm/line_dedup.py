"""Lines that many documents share, dropped everywhere but in one document; decisions are compressed bitmaps, not texts.

Long enough lines go out as (hash of the key, document, position): 128 bits for the key, never the line. Rows are range
partitioned by all of that and sorted, so a key's documents stand together, the largest first, however many rows it
has: a hot key simply spans partitions. Tasks stream their rows. A key that begins and ends inside a partition is
decided there; of the first and last key of a partition the task states the documents, as many as it takes at most,
and these statements, put together, decide the rows that were left open. Positions to drop become one bitmap per document (deflated bits, 1: keep), which a join by (id, hash of the text) brings back to the text.

Defined results: a null text is one empty line. A null id is smaller than all others, and rows with a null id are one
document. Rows that repeat an id are one document too: they count once, and if that document is the largest that holds a
key, the key's lines stay in all of its rows. Rows that repeat id and text get equal bitmaps. Empty tables give no rows.
Extra columns are ignored, or kept by `apply` where asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import map_batches, materialise

_WHITE = b" \t\n\x0b\x0c\r"
_DROP, _OPEN, _SAYS = 0, 1, 2
_LINE = "h1 long, h2 long, doc long, row long, pos int"
_KEY = ["h1", "h2"]


def _documents(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """keep, _doc, _row and _text; (_doc, _row) tells texts apart, as ids may repeat or be null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keep, F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_row"), text.alias("_text"))


def long_lines(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(position, digest of the key) of lines whose key has at least `least` code points. Key: A-Z lower-cased, white space off both ends."""
    text = text.lower()  # of bytes: A-Z alone
    at = pos = 0
    while at <= len(text):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        if end - at >= least:
            key = text[at:end].strip(_WHITE)
            if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                yield pos, hashlib.blake2b(key, digest_size=16).digest()
        at, pos = end + 1, pos + 1


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(h1, h2, doc, row, pos) of every line whose key has at least `least` code points."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, pos, digests = [], [], []
            for i, text in enumerate(batch.column("_text")):
                for p, digest in long_lines(text.as_buffer().to_pybytes(), least):
                    at.append(i)
                    pos.append(p)
                    digests.append(digest)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column("_doc").take(at), batch.column("_row").take(at), pa.array(pos, pa.int32())], names=["h1", "h2", "doc", "row", "pos"])

        return work

    return map_batches(_documents(docs, id_col, text_col), make, _LINE)


Rows = np.ndarray  # columns h1, h2, doc, row, pos, 1 for a null doc


class Stream:
    """One partition's rows, in order of key, document (largest first), row and position: what is dropped, what stays open, what the ends say.

    Of the first key all rows stay open, as it may have begun before. Rows of the last one are held while it has too few documents
    and go out as open if the partition ends so; from the `documents`-th document on nothing is held.
    """

    def __init__(self, documents: int) -> None:
        self.documents = documents
        self.key: tuple[int, int] | None = None
        self.first = True  # the current key is the partition's first
        self.docs: list[tuple[int, int]] = []  # its documents so far, `documents` at most
        self.held: list[Rows] = []

    def _more(self, rows: Rows) -> Iterator[tuple[int, Rows]]:
        """Rows of the current key."""
        enough = len(self.docs) >= self.documents
        if not enough:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, [2, 5]] != rows[:-1, [2, 5]]).any(1)
            for d in map(tuple, rows[new][:, [2, 5]][: self.documents + 1].tolist()):
                if d not in self.docs and len(self.docs) < self.documents:
                    self.docs.append(d)
        if self.first:
            yield _OPEN, rows
            return
        self.held.append(rows)
        if len(self.docs) >= self.documents:
            held, self.held = np.concatenate(self.held), []
            yield _DROP, held[(held[:, [2, 5]] != self.docs[0]).any(1)]

    def _says(self) -> tuple[int, Rows]:
        return _SAYS, np.array([[*self.key, doc, 0, 0, null] for doc, null in self.docs], np.int64).reshape(-1, 6)

    def take(self, rows: Rows) -> Iterator[tuple[int, Rows]]:
        if not len(rows):
            return
        heads = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        borders = [*heads.tolist(), len(rows)]
        at = 0
        if self.key is None or tuple(rows[0, :2].tolist()) == self.key:
            self.key = tuple(rows[0, :2].tolist())
            yield from self._more(rows[: borders[1]])
            at = 1
        if at == len(heads):
            return
        if self.first:
            yield self._says()
        self.first = False
        tail = heads[-1]
        inside = rows[borders[at] : tail]
        if len(inside):
            new_key = np.concatenate([[True], (inside[1:, :2] != inside[:-1, :2]).any(1)])
            new_doc = new_key.copy()
            new_doc[1:] |= (inside[1:, [2, 5]] != inside[:-1, [2, 5]]).any(1)
            starts, of = np.flatnonzero(new_key), np.cumsum(new_key) - 1
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            keeper = inside[starts][:, [2, 5]][of]
            yield _DROP, inside[(docs[of] >= self.documents) & (inside[:, [2, 5]] != keeper).any(1)]
        self.key, self.docs, self.held = tuple(rows[tail, :2].tolist()), [], []
        yield from self._more(rows[tail:])

    def end(self) -> Iterator[tuple[int, Rows]]:
        if self.key is not None:
            if self.held:
                yield _OPEN, np.concatenate(self.held)
            yield self._says()


def dropped_lines(lines: DataFrame, documents: int) -> DataFrame:
    """(doc, row, pos) of the lines that go: of keys in at least `documents` documents, all outside the largest. lines is run once."""
    order = [F.col("h1"), F.col("h2"), F.desc_nulls_last("doc"), F.col("row"), F.col("pos")]
    dealt = materialise(lines, "lines").repartitionByRange(*order).sortWithinPartitions(*order)  # a range partitioning reads its input twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(documents)

        def out(found: Iterator[tuple[int, Rows]]) -> Iterator[pa.RecordBatch]:
            for kind, v in found:
                doc = pa.array(v[:, 2], mask=v[:, 5] == 1)
                columns = [pa.array(np.full(len(v), kind, np.int32)), pa.array(v[:, 0]), pa.array(v[:, 1]), doc, pa.array(v[:, 3]), pa.array(v[:, 4].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "h1", "h2", "doc", "row", "pos"])

        for batch in batches:
            doc = batch.column("doc")
            null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")] + [doc.fill_null(0).to_numpy()] + [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "pos")]
            yield from out(stream.take(np.stack([*columns, null], axis=1)))
        yield from out(stream.end())

    streamed = materialise(dealt.mapInArrow(run, f"kind int, {_LINE}"), "streamed-lines")
    # Two keys a partition at most, each with `documents` rows at most.
    said = streamed.where(F.col("kind") == _SAYS).groupBy(*_KEY).agg(F.max("doc").alias("_keeper"), F.count_distinct(F.struct("doc")).alias("_n")).where(F.col("_n") >= documents)
    late = streamed.where(F.col("kind") == _OPEN).join(F.broadcast(said), _KEY).where(~F.col("doc").eqNullSafe(F.col("_keeper")))
    return streamed.where(F.col("kind") == _DROP).select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def to_bitmap(positions: np.ndarray) -> bytes:
    """Deflated bits, lowest first: 0 at the positions given, 1 elsewhere; all lines after the last bit stay."""
    keep = np.ones(int(positions.max(initial=-1)) // 8 * 8 + 8, bool)  # whole bytes
    keep[positions] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def from_bitmap(bitmap: bytes | None, lines: int) -> np.ndarray:
    """Whether each of a text's lines stays; without a bitmap all do."""
    if bitmap is None:
        return np.ones(lines, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:lines].astype(bool)
    return np.concatenate([bits, np.ones(lines - len(bits), bool)])


def bitmaps(docs: DataFrame, id_col: str, text_col: str, least: int = 40, documents: int = 5) -> DataFrame:
    """(doc, row, keep) of every text that loses a line; row is the text's xxhash64 and keep a bitmap as of to_bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([to_bitmap(np.asarray(p.values.to_numpy(), np.int64)) for p in batch.column("p")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), keep], names=["doc", "row", "keep"])

    drops = dropped_lines(hashed_lines(docs, id_col, text_col, least), documents)
    # A group is the lines of one text, however often the text is repeated.
    return drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("p")).mapInArrow(run, "doc long, row long, keep binary")


def kept_ranges(text: bytes, keep: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) in text of each run of lines that stay."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(text)]])
    step = np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))
    return zip(starts[np.flatnonzero(step == 1)].tolist(), ends[np.flatnonzero(step == -1) - 1].tolist())


def apply(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, *keep: Column, with_text: bool = True) -> DataFrame:
    """keep, n_lines, n_dropped, kept_sha256 (and kept_text) of every row of docs, by the bitmaps found for them."""
    rows = _documents(docs, id_col, text_col, *keep)
    names = rows.columns[: len(rows.columns) - 3]
    found = found.select(F.col("doc").alias("_d"), F.col("row").alias("_r"), F.col("keep").alias("_keep"))
    joined = rows.join(found, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left").select(*names, "_text", "_keep")
    more = "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(names)]] + [more])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines, dropped, digests, texts = [], [], [], []
            for text, bitmap in zip(batch.column("_text"), batch.column("_keep")):
                data = text.as_buffer().to_pybytes()
                n = data.count(b"\n") + 1
                if (bitmap := bitmap.as_py()) is not None:
                    stays = from_bitmap(bitmap, n)
                    data = b"\n".join(data[a:b] for a, b in kept_ranges(data, stays))
                    dropped.append(n - int(stays.sum()))
                else:
                    dropped.append(0)
                lines.append(n)
                digests.append(hashlib.sha256(data).hexdigest())
                if with_text:
                    texts.append(data.decode())
            columns = [*(batch.column(c) for c in names), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=[*names, "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text])

        return work

    return map_batches(joined, make, schema)


def drop_repeated_lines(docs: DataFrame, id_col: str, text_col: str, *keep: Column, least: int = 40, documents: int = 5, with_text: bool = True) -> DataFrame:
    """id, keep, n_lines, n_dropped, kept_sha256 (and kept_text): every document without the lines of at least `least` code points that `documents` documents hold, but in the largest of them."""
    found = materialise(bitmaps(docs, id_col, text_col, least, documents), "bitmaps")
    return apply(docs, found, id_col, text_col, F.col(id_col), *keep, with_text=with_text)


ORACLE = r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
