"""Words of a column of texts, found on the bytes of a whole Arrow batch at once.

A word is a maximal run of a-z, 0-9 and characters beyond ASCII, after A-Z (and no other letter) are lower-cased. All
borders are ASCII, so bytes tell them as well as characters do. Words never cross rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True

#: Bytes of text that are looked at together; a longer text is looked at alone.
BLOCK = 4 << 20


@dataclass
class Words:
    """data: lower-cased bytes; starts, lengths, rows: of each word, in order; first: of rows + 1 borders, the words before each row."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, rows + 1 borders); null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find(column: pa.Array) -> Words:
    """The words of every row."""
    raw, at = text_bytes(column)
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = at[:-1] < at[1:]
    edges = at[:-1][filled], at[1:][filled] - 1
    start[edges[0]], end[edges[1]] = inside[1:-1][edges[0]], inside[1:-1][edges[1]]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(starts, at))


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most size bytes of text, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


# --- CRC-32 as linear algebra over GF(2) ----------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """What a CRC register of one byte becomes after eight shifts, by the polynomial of zlib's CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _byte_table()
_8, _FF = np.uint32(8), np.uint32(0xFF)


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), as four tables of 256 columns' sums, times every crc."""
    return matrix[0][crc & _FF] ^ matrix[1][(crc >> _8) & _FF] ^ matrix[2][(crc >> np.uint32(16)) & _FF] ^ matrix[3][crc >> np.uint32(24)]


def _powers(n: int) -> list[np.ndarray]:
    """The matrices that shift a CRC over 2^k bytes of zeros, k below n: the first from the byte table, each next the square of the last."""
    v = np.arange(256, dtype=np.uint32)
    out = [np.stack([_TABLE[x & _FF] ^ (x >> _8) for x in (v << np.uint32(8 * j) for j in range(4))])]
    for _ in range(1, n):
        out.append(np.stack([_apply(out[-1], column) for column in out[-1]]))
    return out


_SHIFT = _powers(40)


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc followed by lengths bytes of zeros, as far as the linear part goes: the powers of the length's set bits, one after another."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        out[at] = _apply(_SHIFT[k], out[at])
    return out


def combined(a: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations of strings with CRCs a and b, the latter of b_lengths bytes."""
    return shifted(a, b_lengths) ^ b


def crcs(words: Words, by_step: int = 32) -> np.ndarray:
    """zlib.crc32 of every word: all words of at most by_step bytes go byte by byte together, longer ones through zlib."""
    out = np.zeros(len(words.starts), np.uint32)
    order = np.argsort(words.lengths, kind="stable")
    sizes = words.lengths[order]
    short = order[: np.searchsorted(sizes, by_step, "right")]
    starts, done = words.starts[short], np.searchsorted(sizes[: len(short)], np.arange(by_step + 1), "right")
    c = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for step in range(by_step):
        lo = done[step]  # words of at most `step` bytes have ended
        if lo == len(short):
            break
        c[lo:] = _TABLE[(c[lo:] ^ words.data[starts[lo:] + step]) & _FF] ^ (c[lo:] >> _8)
    out[short] = ~c
    for i in order[len(short) :].tolist():
        out[i] = zlib.crc32(words.data[words.starts[i] : words.starts[i] + words.lengths[i]])
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def run_crcs(words: Words, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to longest: (CRCs of all runs of n words joined by one space, the rows they are in). No run's text is made."""
    one, rows = crcs(words), words.rows
    out, run = [(one, rows)], one  # run[i]: of the n words from word i on, whatever their rows
    for n in range(2, longest + 1):
        spaced = _apply(_SHIFT[0], run[:-1]) ^ _SPACE
        run = combined(spaced, one[n - 1 :], words.lengths[n - 1 :])
        inside = rows[n - 1 :] == rows[: len(run)]
        out.append((run[inside], rows[n - 1 :][inside]))
    return out
