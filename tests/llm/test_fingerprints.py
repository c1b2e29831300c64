import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarkflow.llm import cdc
from quarkflow.llm.queries import op7_document_fingerprints

from .oddities import empty, odd


def naive_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(cdc.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def naive_ends(data):
    h, ends, at = naive_gear(data), [], 0
    while at < len(data):
        end = len(data)
        for i in range(at + cdc.MIN, min(len(data), at + cdc.MAX + 1)):
            mask = cdc.STRICT if i <= at + cdc.NORMAL else cdc.LOOSE
            if h[i - 1] & int(mask) == 0 or i == at + cdc.MAX or (i == at + cdc.NORMAL and h[i - 1] & int(cdc.LOOSE) == 0):
                end = i
                break
        ends.append(end)
        at = end
    return ends


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=1500))
def test_vectorised_hash_and_cuts(data):
    assert cdc.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == naive_gear(data)
    assert cdc.chunk_ends(data) == naive_ends(data)


def test_sizes_and_shift_resistance():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 123, 50_000, dtype=np.uint8))
    sizes = np.diff([0, *cdc.chunk_ends(data)])
    assert sizes[:-1].min() >= cdc.MIN and sizes.max() <= cdc.MAX and 25 < sizes.mean() < 80
    shifted = b"inserted at the front " + data
    assert cdc.likeness(cdc.chunk_set(data), cdc.chunk_set(shifted)) > 0.99
    assert cdc.likeness(cdc.chunk_set(data), cdc.chunk_set(data[:25_000])) > 0.99  # contained
    other = bytes(rng.integers(97, 123, 50_000, dtype=np.uint8))
    assert cdc.likeness(cdc.chunk_set(data), cdc.chunk_set(other)) == 0
    assert cdc.likeness({}, {}) == 1 and cdc.likeness({}, cdc.chunk_set(data)) == 0


def expected(rows):
    """rows: (id, text) in order."""
    out = []
    texts = [t or "" for _, t in rows]
    for (i, _), own, after in zip(rows, texts, texts[1:] + texts[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = (cdc.chunk_set(x.encode()) for x in (own, edited, after))
        assert cdc.from_string(cdc.to_string(a)) == a
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), cdc.to_string(a), cdc.to_string(b), round(cdc.likeness(a, b), 12), round(cdc.likeness(a, c), 12)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 12), round(r[6], 12)) for r in df.collect()), key=repr)


def test_documents_against_brute_force(spark, data):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    assert found(op7_document_fingerprints(spark, data)) == expected(rows)


def in_order(df):
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text or ""))]


@pytest.mark.parametrize("ids", ["large", "nulls among large", "all equal", "all null", "repeated rows"])
def test_no_row_is_lost(spark, ids):
    rng = np.random.default_rng(4)
    large = rng.integers(-(2**62), 2**62, 2000).tolist()
    number = {"large": large, "nulls among large": [None if n % 3 == 0 else x for n, x in enumerate(large)], "all equal": [2**62 + 1] * 2000, "all null": [None] * 2000, "repeated rows": [large[n % 5] for n in range(2000)]}[ids]
    rows = [(i, f"text {n % 5 if ids == 'repeated rows' else n} " * 9) for n, i in enumerate(number)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(cdc.fingerprints(df, "doc_id", "text"))
    assert len(got) == 2000 and got == expected(in_order(df))


def test_a_part_without_its_end_is_an_error(spark, monkeypatch):
    whole = cdc.next_document
    monkeypatch.setattr(cdc, "next_document", lambda *a: whole(*a).where("not _copy"))
    with pytest.raises(Exception, match="ends without the document after it"):
        cdc.fingerprints(odd(spark), "doc_id", "text").collect()


def test_odd_rows(spark):
    rows = in_order(odd(spark))
    assert found(cdc.fingerprints(odd(spark), "doc_id", "text")) == expected(rows)
    assert cdc.fingerprints(empty(spark), "doc_id", "text").count() == 0


def test_one_row_is_its_own_next(spark):
    (r,) = cdc.fingerprints(spark.createDataFrame([(7, "abcdef" * 30)], "doc_id long, text string"), "doc_id", "text").collect()
    assert r.near_next == 1.0
