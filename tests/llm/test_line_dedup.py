"""Lines shared by many documents, against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarkflow.llm import line_dedup
from tests.llm.oddities import empty, odd

WHITE = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, least, documents):
    """docs: (id, text). Rows of (id, lines, dropped, sha256, text)."""
    key = lambda line: line.strip(WHITE).translate(_LOWER)
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    gone = {k: max(v, key=order) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        kept = "\n".join(left)
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(map(tuple, line_dedup.drop_repeated_lines(df, "doc_id", "text", **kw).collect()), key=repr)


def test_equals_brute_force(spark):
    random.seed(9)
    common = [f"Shared line number {i} of some length é" for i in range(12)]
    line = lambda: random.choice([random.choice(common), f"  {random.choice(common).upper()}\t", f"own {random.random()} words that are long enough", "short", "", "\r"])
    docs = [(random.choice([i, i, i, None, 7]), random.choice([None, *["\n".join(line() for _ in range(random.randint(0, 12)))] * 9])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for least, documents in ((20, 5), (1, 2), (38, 30), (39, 1)):
        assert run(df, least=least, documents=documents) == brute(docs, least, documents)


def test_a_key_over_many_partitions(spark):
    """A line in every document spans partitions; so do its documents, each of which holds it many times."""
    hot = "the very same line in all of the documents there are"
    docs = [(i, "\n".join([hot] * (i % 4 + 1) + [f"line of document {i} and of no other document"])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(df) == brute(docs, 40, 5)
        few = spark.createDataFrame(docs[:4], "doc_id long, text string")
        assert run(few) == brute(docs[:4], 40, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6)), max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=5), st.integers(1, 4))
def test_streams_decide_alike_however_rows_are_cut(cells, cuts, documents):
    """Rows of (key, document) in order, cut into partitions and batches at any place."""
    cells = sorted(cells, key=lambda c: (c[0], -c[1]))
    rows = np.array([[k, 0, d, 0, i, 0] for i, (k, d) in enumerate(cells)], np.int64).reshape(-1, 6)
    drops, open_, said = set(), [], defaultdict(set)
    at = 0
    while at < len(rows):
        size = cuts[at % len(cuts)] * 3
        stream = line_dedup.Stream(documents)
        part, at = rows[at : at + size], at + size
        for b in range(0, len(part), cuts[0]):
            for kind, v in [*stream.take(part[b : b + cuts[0]])]:
                {0: lambda v: drops.update(v[:, 4].tolist()), 1: lambda v: open_.extend(v.tolist()), 2: lambda v: [said[r[0]].add(r[2]) for r in v.tolist()]}[kind](v)
        for kind, v in stream.end():
            {0: lambda v: drops.update(v[:, 4].tolist()), 1: lambda v: open_.extend(v.tolist()), 2: lambda v: [said[r[0]].add(r[2]) for r in v.tolist()]}[kind](v)
    drops |= {r[4] for r in open_ if len(said[r[0]]) >= documents and r[2] != max(said[r[0]])}
    holders = defaultdict(set)
    for k, d in cells:
        holders[k].add(d)
    assert drops == {i for i, (k, d) in enumerate(cells) if len(holders[k]) >= documents and d != max(holders[k])}


@given(st.sets(st.integers(0, 100)), st.integers(101, 140))
def test_bitmaps_return_the_lines(positions, lines):
    keep = line_dedup.from_bitmap(line_dedup.to_bitmap(np.array(sorted(positions), np.int64)), lines)
    assert len(keep) == lines and set(np.flatnonzero(~keep).tolist()) == positions


def test_odd_documents(spark):
    docs = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    for least, documents in ((40, 5), (5, 2), (0, 2)):
        assert run(odd(spark), least=least, documents=documents) == brute(docs, least, documents)
    assert run(empty(spark)) == []
    kept = line_dedup.drop_repeated_lines(odd(spark), "doc_id", "text", F.col("spans"), F.col("part"), with_text=False)
    assert kept.columns == ["doc_id", "spans", "part", "n_lines", "n_dropped", "kept_sha256"] and kept.count() == len(docs)


def test_long_texts(spark):
    """A million empty lines, and one line of a million characters."""
    shared = "y" * 50
    docs = [(i, t) for i, t in enumerate(["\n" * 1_000_000 + shared, "x" * 1_000_000 + "\n" + shared, f"a\n{shared}", shared, f"{shared}\n{shared}", "é" * 39])]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 40, 5)
