"""Packing token sequences by minimum bin slack.

How pieces can be packed depends on their lengths alone, and there are at most `capacity` lengths. So Spark counts the
pieces by length, the driver plans bins on that histogram, and Spark deals the pieces out to the planned places by
their rank among the pieces of their length.

The plan: a bin is opened for the longest length left; a bitset subset-sum over the other available lengths, with
their numbers, finds the fullest combination that still fits; the combination is taken as often as the numbers allow
and removed. A plan has a few rows per length, however many pieces there are. Ranks come from a range partitioning by
(length, id, piece), which splits a length that a third of all pieces may share.

Defined results: a null text is the empty text (one piece: the end token alone). Repeated rows are packed each for
itself; ids may be null; extra columns are ignored. An empty table packs to no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm import bpe
from quarkflow.llm.common import map_batches, materialise

CAPACITY = 2048
_PIECE = "piece int, start long, length long, ids_crc32 long"


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_encoders: dict[tuple[str, str], object] = {}


def fast_encoder(json_path: str, pattern: str):
    """A tiktoken encoding of a byte-level tokenizer file: its ids are those of the tokenizers library (tests hold them equal), several times as fast.

    The file's ids rank its merges, so the vocabulary is a rank table. Added tokens are found in texts before anything
    else, as the library does; a file that asks for more (a normaliser, white space taken in, whole words) is refused.
    """
    if (json_path, pattern) not in _encoders:
        import tiktoken

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or ()
        if spec.get("normalizer") or any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{json_path} asks for more than byte-level merges and plain added tokens")
        of = byte_of_char()
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _encoders[json_path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[json_path, pattern]


def file_ids(json_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32) of a byte-level tokenizer file.

    The fast encoder's matcher gives up on runs of some hundred thousand white spaces. Such a text is cut at the added
    tokens and by the pattern with a matcher that needs no stack, and goes through the transducer of bpe.Encoder.
    """
    fast = fast_encoder(json_path, pattern)
    slow: list[bpe.Encoder] = []

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            if not slow:
                slow.append(bpe.Encoder(fast._mergeable_ranks, pattern))
        added = {t: fast.encode_single_token(t) for t in fast.special_tokens_set}
        between = re.split("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")", text) if added else [text]
        parts = [np.array([added[x]], "<u4") if i % 2 else np.frombuffer(slow[0].encode_bytes(x), "<u4") for i, x in enumerate(between)]
        return np.concatenate(parts)

    return ids


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def tokenize(df: DataFrame, text_col: str, json_path: str, pattern: str, *keep: Column, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """keep, piece, start, length and ids_crc32 (and ids) of every piece of every row's text, each text ending in end_id."""
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = [f.name for f in kept.schema.fields[:-1]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [_PIECE] + ["ids array<int>"] * with_ids)

    def make():
        encode = file_ids(json_path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                for k, (at, n) in enumerate(cuts(len(tokens), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(tokens[at : at + n].tobytes()))
                    if with_ids:
                        ids.append(tokens[at : at + n].astype("<i4"))
            at = pa.array(row, pa.int64())
            out = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), *out], names=[*names, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

        return work

    return map_batches(kept, make, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of lengths in counts whose sum is the largest that is at most room: subset sums as bits of an integer."""
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for size in sorted(counts, reverse=True):
        if size > room:
            continue
        left, part = min(counts[size], room // size), 1
        while left > 0:
            take = min(part, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & limit
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> target & 1:
            chosen[size] = chosen.get(size, 0) + take
            target -= size * take
    return list(chosen.items())


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination of (length, times), number of bins) until counts (length to number) are used up."""
    left = {size: n for size, n in counts.items() if n > 0}
    if any(not 0 < size <= capacity for size in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        bin_: dict[int, int] = {longest: 1}
        for size, times in fullest({k: v for k, v in rest.items() if v}, capacity - longest):
            bin_[size] = bin_.get(size, 0) + times
        bins = min(left[size] // times for size, times in bin_.items())
        plan.append((sorted(bin_.items(), reverse=True), bins))
        for size, times in bin_.items():
            left[size] -= times * bins
            if not left[size]:
                del left[size]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, times in a bin, first bin, offset of the first of them), ranks rising."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bin_ = 0
    for combination, bins in plan:
        offset = 0
        for size, times in combination:
            out.setdefault(size, []).append((used.get(size, 0), times, bin_, offset))
            used[size] = used.get(size, 0) + times * bins
            offset += size * times
        bin_ += bins
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(pieces: DataFrame, *order: str, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. order: columns that tell equal lengths apart. pieces is run once."""
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = materialise(pieces, "pieces")  # a range partitioning reads its input twice, to sample it and to deal it out
    ranked = materialise(
        pieces.repartitionByRange(F.col(length_col), *(F.col(c) for c in order)).sortWithinPartitions(length_col, *order).withColumn("_at", F.monotonically_increasing_id()), "pack"
    )
    # A partition holds a range of lengths: this is one row per partition and length that share pieces.
    sizes = sorted((r.p, r.s, r.n) for r in ranked.groupBy(F.shiftright("_at", 33).alias("p"), F.col(length_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    first: dict[int, dict[int, tuple[int, int]]] = {}  # length: partition: (rank of its first piece, place in the partition)
    counts: dict[int, int] = {}
    within: dict[int, int] = {}
    for part, size, n in sizes:
        first.setdefault(size, {})[part] = (counts.get(size, 0), within.get(part, 0))
        counts[size] = counts.get(size, 0) + n
        within[part] = within.get(part, 0) + n
    shared = spark.sparkContext.broadcast((first, places(plan_bins(counts, capacity))))  # at most capacity lengths, a few rows each
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields] + ["sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seats = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at").to_numpy()
            size = batch.column(length_col).to_numpy()
            part, here = at >> 33, at & ((1 << 33) - 1)
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                base = np.array([first[s][p][0] - first[s][p][1] for p in part[rows].tolist()])
                rank = base + here[rows]
                seat = seats[s][np.searchsorted(seats[s][:, 0], rank, "right") - 1]
                nth = rank - seat[:, 0]
                sequence[rows] = seat[:, 2] + nth // seat[:, 1]
                offset[rows] = seat[:, 3] + nth % seat[:, 1] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry ids: the training sequences. A group is at most a capacity of tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
