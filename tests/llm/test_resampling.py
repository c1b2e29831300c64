"""Words, CRC algebra and the resampling draw, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarkflow.llm import resampling, words
from tests.llm.oddities import empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(_LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZz09 é日\n\x00_-İ", max_size=60)), max_size=12), st.integers(1, 4))
def test_words_and_runs_are_those_of_plain_text(texts, longest):
    column = pa.array(["some thing before", *texts], pa.string()).slice(1)
    found = words.find(column)
    assert [[bytes(found.data[s : s + n]).decode() for s, n in zip(found.starts[a:b], found.lengths[a:b])] for a, b in zip(found.first, found.first[1:])] == [plain_words(t) for t in texts]
    for n, (crc, rows) in enumerate(words.run_crcs(found, longest), 1):
        want = [(zlib.crc32(" ".join(w[i : i + n]).encode()), r) for r, w in enumerate(map(plain_words, texts)) for i in range(len(w) - n + 1)]
        assert list(zip(crc.tolist(), rows.tolist())) == want


def test_crcs_compose_over_any_length():
    rng = np.random.default_rng(3)
    for n in (0, 1, 31, 32, 33, 1000, 1_048_577):
        a, b = rng.bytes(100), rng.bytes(n)
        got = words.combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(a + b)
    long = words.find(pa.array(["x" * 100_000 + " y"]))
    assert words.run_crcs(long, 2)[1][0][0] == zlib.crc32(b"x" * 100_000 + b" y")


def test_blocks_hold_all_rows_and_split_at_size():
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "bb", "c" * 50, "", "d"]})
    parts = list(words.blocks(batch, "t", 6))
    assert [x for p in parts for x in p.column("t").to_pylist()] == ["aaaa", None, "bb", "c" * 50, "", "d"] and len(parts) == 3
    assert not list(words.blocks(batch.slice(0, 0), "t"))


def brute(docs, target, buckets=10_000, longest=2, percent=25, least=20, seed=7):
    def features(text):
        w = plain_words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for b in features(text)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for i, text in docs:
        n, fs = features(text)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    drawn = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {}
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in out), key=repr)


def test_resample_equals_brute_force(spark):
    random.seed(5)
    word = lambda: random.choice(["alpha", "Beta", "gamma", "delta9", "épsilon", "zeta", "eta", "theta"]) + random.choice(["", "x", "yy"])
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 60)))) for i in range(400)]
    target = [(i, " ".join(random.choice(["alpha", "Betax", "zeta"]) for _ in range(30))) for i in range(10)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "item_id long, text string")
    for kw in ({}, {"buckets": 50, "longest": 3, "percent": 40, "least_words": 5, "seed": 1}):
        got = resampling.resample(d, t, "doc_id", "text", "text", **kw)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, **{("least" if k == "least_words" else k): v for k, v in kw.items()})


def test_odd_documents(spark):
    docs = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    target = spark.createDataFrame([(1, "plain words"), (2, None), (3, "")], "item_id long, text string")
    got = resampling.resample(odd(spark), target, "doc_id", "text", "text", percent=50, least_words=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, [(1, "plain words"), (2, None), (3, "")], percent=50, least=2)
    assert resampling.resample(empty(spark), target, "doc_id", "text", "text").collect() == []
    none = resampling.resample(odd(spark), target.where("false"), "doc_id", "text", "text", percent=50, least_words=2)
    assert sorted(map(tuple, none.collect()), key=repr) == brute(docs, [], percent=50, least=2)


def test_ranks_cross_partitions(spark):
    rows = spark.range(20_000).select("id", (F.xxhash64("id") % 50).alias("s"))
    got = resampling.ranked(rows, F.col("s") >= 0, 100, F.desc("s"), F.col("id")).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and [(-r.s, r.id) for r in got] == sorted((-r.s, r.id) for r in got)
    assert len(got) == rows.where("s >= 0").count()
