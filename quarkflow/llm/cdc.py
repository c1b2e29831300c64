"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes is taken at every byte (all places at once, by doubling the window). Chunks are cut
where it has a run of zero bits: a longer run is asked for before the normal size, a shorter one after it, none beyond
the largest size, so sizes stay near the normal one; after an insertion the cuts fall back into step. A fingerprint is
the set of (chunk digest, chunk length); two fingerprints are compared by the length of the chunks they share, as a
part of the shorter one: containment.

Defined results: a null text is the empty text; its fingerprint is empty. Two empty fingerprints have likeness 1, an
empty and another one 0. next_document(): rows of equal id follow each other in the order of a hash of their texts
(then of the texts), rows with a null id come first in the same order. As many rows come out as went in. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import mix64

MIN, NORMAL, MAX = 16, 40, 160
#: Bits of the hash that must be zero before and after the normal size. The top bits depend on the whole window.
STRICT, LOOSE = np.uint32(0xFC000000), np.uint32(0xF0000000)
#: A byte's random number.
GEAR = (mix64(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_DIGITS, _SIZE_DIGITS = 20, 2


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash (h << 1) + GEAR[byte] at every byte, which 32 shifts make a window of 32 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) <= k:
            break
        h[k:] += h[:-k] << np.uint32(k)  # the right side is computed before it is added
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= MIN:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    strict.append(1 << 62)
    loose.append(1 << 62)
    ends, at = [], 0
    while n - at > MIN:
        end = strict[bisect_left(strict, at + MIN)]
        if end > at + NORMAL:
            end = min(loose[bisect_left(loose, at + NORMAL)], at + MAX)
        if end >= n:
            break
        ends.append(end)
        at = end
    return [*ends, n]


def chunk_set(data: bytes) -> dict[str, int]:
    """Digest to length of the distinct chunks."""
    out, at, blake = {}, 0, hashlib.blake2b
    for end in chunk_ends(data):
        out[blake(data[at:end], digest_size=_DIGITS // 2).hexdigest()] = end - at
        at = end
    return out


def to_string(chunks: dict[str, int]) -> str:
    """Fixed-width digests and hexadecimal lengths in the digests' order; equal sets give equal strings."""
    return "".join([f"{d}{chunks[d]:0{_SIZE_DIGITS}x}" for d in sorted(chunks)])


def from_string(s: str) -> dict[str, int]:
    w = _DIGITS + _SIZE_DIGITS
    return {s[i : i + _DIGITS]: int(s[i + _DIGITS : i + w], 16) for i in range(0, len(s), w)}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Shared length as a part of the shorter set's length."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return shared / min(sum(a.values()), sum(b.values()))


def _borders(docs: DataFrame, parts: int, draw: int) -> list[tuple[int | None, int]]:
    """Keys (id, hash) that occur, in order, the smallest of all first; each begins a part. The driver holds about draw * parts keys."""
    about = docs.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.min("id").alias("lo")).first()
    if not about.n:
        return []
    first = docs.where(F.col("id").isNull() if about.ids < about.n else F.col("id") == about.lo).agg(F.min("h").alias("h")).first().h
    start = (None if about.ids < about.n else about.lo, first)
    if parts < 2:
        return [start]
    rows = docs.sample(min(1.0, draw * parts / about.n), seed=17).select("id", "h").collect()
    keys = sorted(((r.id, r.h) for r in rows), key=_in_order)
    step = max(1, -(-len(keys) // parts))
    return sorted({start, *keys[step::step]}, key=_in_order)


def _in_order(key: tuple[int | None, int]) -> tuple[bool, int, int]:
    return key[0] is not None, key[0] or 0, key[1]


def next_document(df: DataFrame, id_col: str, text_col: str, parts: int | None = None, draw: int = 50) -> DataFrame:
    """Rows (_part, _copy, id, text) dealt and sorted so that a part's rows follow each other by (id, hash of the text, text) and end with a copy of the row after them (the first row of all after the last).

    Parts begin at keys (id, hash) that occur in the table, drawn from a row sample, so the row to copy is the least
    text of the next part's first key: one text per part is fetched for it, by a join with the borders. Equal ids
    and null ids are parted by their texts; only rows equal in id and text stay together.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    borders = _borders(docs, parts, draw)
    nulls = sum(i is None for i, _ in borders)
    ids = np.array([i for i, _ in borders if i is not None], np.int64)
    hashes = np.array([h for _, h in borders], np.int64)

    @F.pandas_udf("int")
    def part_of(known: pd.Series, number: pd.Series, h: pd.Series) -> pd.Series:
        """The last border at or before a row's key."""
        number, h = number.to_numpy(np.int64), h.to_numpy(np.int64)
        low = np.where(known, nulls + np.searchsorted(ids, number, "left"), 0)
        high = np.where(known, nulls + np.searchsorted(ids, number, "right"), nulls)
        out = high.copy()
        for a, b in {(int(x), int(y)) for x, y in zip(low[low < high], high[low < high])}:  # borders of the row's own id
            here = (low == a) & (high == b)
            out[here] = a + np.searchsorted(hashes[a:b], h[here], "right")
        return pd.Series((out - 1).astype(np.int32))

    own = part_of(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), F.col("h"))
    dealt = docs.select(own.alias("_part"), F.lit(False).alias("_copy"), "id", "h", "text")
    # A row per part: its first one, as the last of the part before.
    begins = spark.createDataFrame([((k - 1) % len(borders), i, h) for k, (i, h) in enumerate(borders)], "_part int, i long, b long")
    copies = docs.join(F.broadcast(begins), docs["id"].eqNullSafe(begins["i"]) & (docs["h"] == begins["b"])).groupBy("_part", "id", "h").agg(F.min("text").alias("text"))
    ends = copies.select("_part", F.lit(True).alias("_copy"), "id", "h", "text")
    return dealt.unionByName(ends).repartition(parts, "_part").sortWithinPartitions("_part", "_copy", "id", "h", "text")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see the module)."""
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split(" ")[0].strip("`") for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, id, text, its chunks: a row that waits for the next
        for batch in batches:
            out: list[tuple] = []
            for part, copy, i, text in zip(*(batch.column(c) for c in ("_part", "_copy", "id", "text"))):
                part, copy, i, text = part.as_py(), copy.as_py(), i.as_py(), text.as_py()
                ended = held is None or held[0] != part
                if ended and held is not None:
                    raise ValueError(f"part {held[0]} ends without the document after it")
                chunks = chunk_set(text.encode()) if not copy or not ended else None
                if not ended:
                    _, own_id, own, own_chunks = held
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + text[:half]).encode()
                    edited_chunks = chunk_set(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), to_string(own_chunks), to_string(edited_chunks), likeness(own_chunks, edited_chunks), likeness(own_chunks, chunks)))
                held = None if copy else (part, i, text, chunks)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if held is not None:
            raise ValueError(f"part {held[0]} ends without the document after it")

    return next_document(df, id_col, text_col).mapInArrow(run, schema)
