import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarkflow.llm import binpack, bpe

from .oddities import empty, odd

PATH, JSON = str(P.path("byte_bpe_50k.tiktoken")), str(P.path("byte_bpe_50k.json"))
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = bpe.Encoder(RANKS, P.PATTERN), bpe.Decoder(RANKS)
TIGHT = bpe.Encoder(RANKS, P.PATTERN, max_words=5)
TIGHT.fst.max_states = 20
TIGHT.fst.max_pairs = 20


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("abcdehiorst ABC\n\t'é日🙂1!"), st.text("ab", max_size=400)))
def test_encodes_as_the_library_and_back(text):
    want = REFERENCE.encode_ordinary(text)
    assert ENCODER.encode(text) == want == TIGHT.encode(text)
    assert DECODER.decode(want) == text


def test_long_words_and_every_token():
    for text in ("a" * 20_000, "ab" * 5000 + "!" * 3000, " " * 4000 + "x"):
        assert ENCODER.encode(text) == TIGHT.encode(text) == REFERENCE.encode_ordinary(text)
    assert all(ENCODER.fst.encode(t) == [i] for t, i in list(RANKS.items())[::97])


def test_pairs_agree_with_merging():
    rng = np.random.default_rng(0)
    ids = list(RANKS.values())
    for a, b in rng.choice(ids, (3000, 2)).tolist():
        fst = ENCODER.fst
        assert fst.may_follow(a, b) == (fst.merge(fst.tokens[a] + fst.tokens[b]) == [a, b])


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40)))
def test_utf8_stream_takes_any_cut(data, cuts):
    cuts = sorted(c for c in cuts if c <= len(data))
    stream = bpe.Utf8Stream()
    out = "".join(stream.feed(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])) + stream.close()
    assert out == data.decode("utf-8", "replace")


def test_roundtrip_of_odd_rows(spark):
    rows = bpe.roundtrip(odd(spark), "text", PATH, P.PATTERN, F.col("doc_id"), F.col("text"), F.col("id"), with_ids=True).collect()
    assert len(rows) == 11
    for r in rows:
        ids = REFERENCE.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.roundtrip(empty(spark), "text", PATH, P.PATTERN, F.col("doc_id")).count() == 0


def test_roundtrip_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in bpe.roundtrip(docs, "text", PATH, P.PATTERN, F.col("text")).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(REFERENCE.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()


# --- packing


def library():
    return Tokenizer.from_file(JSON)


def test_fast_encoder_gives_the_librarys_ids(spark, data):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  \n b<|endoftext", "", "é日🙂", "a" * 3000]
    own = binpack.fast_encoder(JSON, P.PATTERN)
    for text, e in zip(texts, library().encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text, allowed_special="all") == e.ids


def check_pieces(rows, texts, capacity=2048):
    """texts: list of (doc_id, text); ids may repeat."""
    t = library()
    want = {}
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (at, n) in enumerate(binpack.cuts(len(ids), capacity)):
            key = (i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packs_documents_close_to_the_bound(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = binpack.pack(binpack.tokenize(docs, "text", JSON, P.PATTERN, F.col("doc_id")), "doc_id", "piece").collect()
    bins = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packs_texts_that_hold_the_added_token(spark):
    texts = [(1, "hello <|endoftext|> x"), (2, "<|endoftext|>" * 3000), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert binpack.fast_encoder(JSON, P.PATTERN).encode(texts[0][1], allowed_special="all") == [31373, 220, 50256, 2124]
    check_pieces(binpack.pack(binpack.tokenize(df, "text", JSON, P.PATTERN, F.col("doc_id")), "doc_id", "piece").collect(), texts)


def test_packs_odd_rows_and_assembles(spark):
    df = odd(spark)
    packed = binpack.pack(binpack.tokenize(df, "text", JSON, P.PATTERN, F.col("doc_id"), F.col("id"), with_ids=True), "doc_id", "piece")
    rows = packed.collect()
    bins = check_pieces(rows, [(r.doc_id, r.text) for r in df.collect()])
    whole = binpack.assemble(packed).collect()
    assert len(whole) == bins and sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert binpack.pack(binpack.tokenize(empty(spark), "text", JSON, P.PATTERN, F.col("doc_id")), "doc_id", "piece").count() == 0


def brute_fullest(counts, room):
    best = {0}
    for size, n in counts.items():
        best = {b + k * size for b in best for k in range(n + 1) if b + k * size <= room}
    return max(best)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest_combination(counts, room):
    got = binpack.fullest(counts, room)
    assert all(n <= counts[s] for s, n in got)
    assert sum(s * n for s, n in got) == brute_fullest(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=12))
def test_plan_uses_every_piece_once(counts):
    plan = binpack.plan_bins(counts, 50)
    used = {}
    for combination, bins in plan:
        assert bins > 0 and sum(s * n for s, n in combination) <= 50
        for s, n in combination:
            used[s] = used.get(s, 0) + n * bins
    assert used == counts


def test_cuts_put_the_short_piece_first():
    assert binpack.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]
    assert binpack.cuts(4096) == [(0, 2048), (2048, 2048)] and binpack.cuts(1) == [(0, 1)]
    with pytest.raises(ValueError):
        binpack.plan_bins({3000: 1})


#: Runs on which a backtracking matcher runs out of stack.
WHITE = {
    "spaces": "x" + " " * 5_000_000 + "y",
    "newlines": "\n" * 5_000_000,
    "tabs": "\t" * 5_000_000 + "end",
    "mixed": " \n\t " * 1_250_000 + "z<|endoftext|> w",
    "several": ("word " * 10 + " " * 1_000_000) * 2 + "<|endoftext|>" + "\r" * 1_000_000,
}


@pytest.mark.parametrize("name", WHITE)
def test_long_white_space_has_the_librarys_ids(name):
    text = WHITE[name]
    with pytest.raises(ValueError):
        binpack.fast_encoder(JSON, P.PATTERN).encode(text, allowed_special="all")
    assert binpack.file_ids(JSON, P.PATTERN)(text).tolist() == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_long_white_space_packs(spark):
    """A row of a million spaces among others: all its pieces are there, in place."""
    docs = spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y"), (2, "a few words"), (3, None)], "doc_id long, text string")
    rows = binpack.pack(binpack.tokenize(docs, "text", JSON, P.PATTERN, F.col("doc_id")), "doc_id", "piece").collect()
    want = Tokenizer.from_file(JSON).encode("x" + " " * 1_000_000 + "y", add_special_tokens=False).ids + [0]
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert sum(r.length for r in mine) == len(want)
    for r in mine:
        assert zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
