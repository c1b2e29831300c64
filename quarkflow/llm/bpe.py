"""Byte-level BPE by a finite-state transducer that is made deterministic as texts need it.

The encoding of every prefix of a word ends in exactly one token, so the prefixes form a tree: a prefix hangs under
what is left when its last token is taken off. Reading a byte adds one node; a node stays open while some token of the
vocabulary could still start there. The open nodes are the state of the transducer, named by the bytes since their
deepest common ancestor and the last tokens on the way; whether a token may follow the one put out last is asked when
it comes up. Bytes lead from state to state, and a token is put out as soon as all open nodes agree on it, which takes
at most a few tokens' lengths of lookahead. States and steps are made when first met and kept in a bounded table
(when it is full it is emptied: speed changes, results don't). Merges come in by a table of token pairs that may stand
side by side, itself filled when first asked.

Decoding maps ids to bytes and runs them through an incremental UTF-8 automaton, so a stream can be cut anywhere.

Defined results: a null text is encoded as the empty text (no ids). Repeated rows are encoded alike; extra
columns are ignored. Bytes that are not UTF-8 decode to U+FFFD per maximal invalid run; the bytes themselves are kept.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import map_batches


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes words (byte strings) to ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 500_000, max_pairs: int = 400_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {i: t for t, i in ranks.items()}
        #: Proper prefixes of tokens: a node may stay open while the bytes since it are one of these.
        prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        #: What a string is: 1 for such a prefix, plus 2 (id + 1) for a token.
        self.known = {s: (s in prefixes) + 2 * (ranks.get(s, -1) + 1) for s in prefixes.union(ranks)}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.bytes = [bytes([b]) for b in range(256)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: the bytes since the root, and for each place among these the last token of the encoding up to there
        # (-1 at the root, -2 at places that no open node hangs under). The root's own last token is the one put out
        # last; it is no part of the state.
        self.numbers: dict[tuple[bytes, tuple[int, ...]], int] = {(b"", (-1,)): 0}
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        # By state and byte: (next state, tokens put out, a token on trial or -1, and the same two if it fails).
        self.steps: dict[int, tuple[int, tuple[int, ...], int, int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, word: bytes, stop: int = 1) -> list[int]:
        """The encoding by its definition: the pair of lowest rank is merged, again and again, until `stop` parts are left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stand side by side in some encoding: iff their bytes are encoded as just these two."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._apart(a, b)
        return ok

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte."""
        if token not in self.halves:
            word = self.tokens[token]
            self.halves[token] = tuple(self.merge(word, stop=2)) if len(word) > 1 else None
        return self.halves[token]

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges on either side of the border, latest first: no merge across it may come before the next undone one.

        A merge across the border of the same rank as one on its left comes after it, of one on its right before it.
        """
        left, right, tokens, ranks = a, b, self.tokens, self.ranks
        before = 1 << 60
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            # The side whose token was made later is undone first; a byte can't be.
            parts, side = (self._halves(left), 0) if left > right else (self._halves(right), 1)
            if parts is None:
                parts, side = (self._halves(right), 1) if side == 0 else (self._halves(left), 0)
                if parts is None:
                    return True
            if side == 0:
                before, left = left, parts[1]
            else:
                before, right = right + 1, parts[0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...], int, int, tuple[int, ...]]:
        """Make the step of a state by a byte.

        The new node's last token is the longest that ends here and may follow the last token of the place where it
        starts. Whether one from the root may is only known with the token put out last: it is on trial.
        """
        since, lasts = self.states[state]
        since += self.bytes[byte]
        known = self.known.get
        trial, token, open_ = -1, -1, []
        for at in range(len(since)):
            code = known(since[at:])
            if code is not None:
                if code & 1:
                    open_.append(at)
                if token < 0 and code > 1:
                    may = (code >> 1) - 1
                    if not at:
                        trial = may
                    elif self.may_follow(lasts[at], may):
                        token = may
        if token >= 0:
            fails = self._settle(since, (*lasts, token), open_)
            return (*fails, -1, *fails) if trial < 0 else (*self._settle(since, (*lasts, trial), open_), trial, *fails)
        if trial < 0:
            raise ValueError("the ranks lack a byte or are not a merge table")
        return (*self._settle(since, (*lasts, trial), open_), -1, 0, ())

    def _settle(self, since: bytes, lasts: tuple[int, ...], open_: list[int]) -> tuple[int, tuple[int, ...]]:
        """(number of the state, tokens put out): the root moves to the last place through which all open nodes hang."""
        size, end = self.size, len(since)
        root = end
        for other in open_:
            while root != other:
                if root > other:
                    root -= size[lasts[root]]
                else:
                    other -= size[lasts[other]]
            if not root:
                break
        alive = {root}
        for at in (end, *open_):
            while at not in alive:
                alive.add(at)
                at -= size[lasts[at]]
        kept = tuple([-1] + [lasts[at] if at in alive else -2 for at in range(root + 1, end + 1)])
        key = (since[root:], kept)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        return number, self._path(lasts, root)

    def _path(self, lasts: tuple[int, ...], at: int) -> tuple[int, ...]:
        """The tokens from the root to a place."""
        out = []
        while at > 0:
            out.append(lasts[at])
            at -= self.size[lasts[at]]
        return tuple(reversed(out))

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word. A word that is a token is that token."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        state, out, steps, last, pairs = 0, [], self.steps, -1, self.pairs
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = steps[state << 8 | byte] = self._step(state, byte)
                if len(self.states) > 2 * self.max_states:  # within one very long word
                    ahead = [self.states[step[0]], self.states[step[3]]]
                    self._reset()
                    steps = self.steps
                    self.states += ahead
                    self.numbers |= {key: i for i, key in enumerate(ahead, 1)}
                    step = (1, step[1], step[2], 2, step[4])
            state, put, trial, otherwise, put_otherwise = step
            if trial >= 0 and last >= 0:
                may = pairs.get((last, trial))
                if not (self.may_follow(last, trial) if may is None else may):
                    state, put = otherwise, put_otherwise
            if put:
                out += put
                last = put[-1]
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._path(self.states[state][1], len(self.states[state][0]))
        out += end
        return out


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to ids: the pattern cuts words, the transducer encodes them; short words' ids are kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = 200_000):
        self.fst, self.cut, self.max_words = Transducer(ranks), regex.compile(pattern).findall, max_words
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = outer.older.get(word)
                if ids is None:
                    ids = pack(outer.fst.encode(word.encode()))
                if len(word) <= 64:
                    self[word] = ids
                return ids

        #: Words of late, and those of the table before: what is used again moves on.
        self.words, self.older, self.table = Words(), {}, Words

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.words) > self.max_words:
            self.older, self.words = self.words, self.table()
        return b"".join(map(self.words.__getitem__, self.cut(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()


class Utf8Stream:
    """An incremental UTF-8 automaton: feed bytes in any pieces, get the text that is complete."""

    #: Classes of bytes and the steps between states are built from the ranges of well-formed UTF-8.
    RANGES = (
        ("start", 0x00, 0x7F, "start"), ("start", 0xC2, 0xDF, "one"), ("start", 0xE0, 0xE0, "e0"), ("start", 0xE1, 0xEC, "two"), ("start", 0xED, 0xED, "ed"),
        ("start", 0xEE, 0xEF, "two"), ("start", 0xF0, 0xF0, "f0"), ("start", 0xF1, 0xF3, "three"), ("start", 0xF4, 0xF4, "f4"), ("one", 0x80, 0xBF, "start"),
        ("two", 0x80, 0xBF, "one"), ("three", 0x80, 0xBF, "two"), ("e0", 0xA0, 0xBF, "one"), ("ed", 0x80, 0x9F, "one"), ("f0", 0x90, 0xBF, "two"), ("f4", 0x80, 0x8F, "two"),
    )
    STEPS = {(s, b): t for s, lo, hi, t in RANGES for b in range(lo, hi + 1)}

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        """Text that data completes. At most three bytes are held back."""
        data = self.held + data
        # Only the last three bytes can belong to an unfinished character.
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                state = "start"
                for x in data[len(data) - back :]:
                    state = self.STEPS.get((state, x), "bad")
                if state not in ("start", "bad"):
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        """What is left at the end of a stream; an unfinished character becomes U+FFFD."""
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes, in pieces of a bounded number of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t

    def pieces(self, ids: bytes, size: int = 65_536) -> Iterator[bytes]:
        for i in range(0, len(ids), 4 * size):
            yield b"".join(map(self.tokens.__getitem__, np.frombuffer(ids[i : i + 4 * size], "<u4").tolist()))

    def decode(self, ids: Iterable[int]) -> str:
        stream = Utf8Stream()
        return "".join([stream.feed(p) for p in self.pieces(np.fromiter(ids, "<u4").tobytes())]) + stream.close()


_made: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def coder(ranks_path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """A process's encoder and decoder; later tasks of a worker find them as they were left."""
    if (ranks_path, pattern) not in _made:
        ranks = load_ranks(ranks_path)
        _made[ranks_path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
        gc.freeze()  # the tables hold no cycles; the collector need not walk them
    return _made[ranks_path, pattern]


def roundtrip(df: DataFrame, text_col: str, ranks_path: str, pattern: str, *keep: Column, with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 (of the decoded text's bytes), and ids if asked, for every row.

    ranks_path is read on the executors; the file must be there on each of them, as the libraries are.
    """
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = [f.name for f in kept.schema.fields[:-1]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids)

    def make():
        encoder, decoder = coder(ranks_path, pattern)

        def one(text: str | None) -> tuple:
            ids = encoder.encode_bytes(text)
            hashed, stream = hashlib.sha256(), Utf8Stream()
            for piece in decoder.pieces(ids):
                hashed.update(stream.feed(piece).encode())
            hashed.update(stream.close().encode())
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashed.hexdigest(), np.frombuffer(ids, "<i4").tolist() if with_ids else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(t.as_py()) for t in batch.column("_text")]
            out = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]
            out += [pa.array([x[3] for x in found], pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

        return work

    return map_batches(kept, make, schema)
