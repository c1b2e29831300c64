"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarkflow.llm import lexical_search, words
from tests.llm.oddities import LONG, empty, odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [t.translate(_LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    N, L = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        rows = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in ts if t in b)
            if score > 0:
                rows.append((-score, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def run(docs, items, **kw):
    return sorted(map(tuple, lexical_search.search(docs, items, "doc_id", "text", "item_id", "text", **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "日本", "straße"]
    text = lambda n: " ".join(random.choice(vocabulary[: random.randint(1, 63)]) for _ in range(n))
    docs = [(i, text(random.randint(0, 40)) if i % 9 else "w1 w2 w3") for i in range(500)]
    return docs, [(i, text(random.randint(0, 12))) for i in range(25)] + [(3, "w59 extra"), (None, "w7 W8"), (99, None), (98, "..!")]


def test_equals_brute_force(spark, corpus):
    docs, items = corpus
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for top in (1, 7, 50, 1000):
        assert run(d, i, top=top) == brute(docs, items, top)


def test_blocks_of_items_and_small_steps(spark, corpus, monkeypatch):
    """Many blocks of items, and products summed up a few at a time, give the same rows."""
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "PAIRS", 40)
    d, i = spark.createDataFrame(docs[:150], "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    assert run(d, i, top=5) == brute(docs[:150], items, 5)


def test_best_lists_equal_a_sort():
    rng = np.random.default_rng(0)
    scores, docs = rng.integers(0, 6, (4, 300)), rng.permutation(300)
    best = lexical_search.Best(4, 10)
    for at in range(0, 300, 37):
        best.add(scores[:, at : at + 37], docs[at : at + 37])
    got = sorted(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist()))
    assert got == sorted(x for i in range(4) for x in sorted((i, -int(s), int(d)) for s, d in zip(scores[i], docs) if s > 0)[:10])


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_search, "word_hashes", lambda found: np.zeros(len(found.starts), np.uint64))
    vocabulary = lexical_search.Vocabulary(["aa", "ab", "b", "é"])
    assert vocabulary.numbers(words.find(pa.array(["AB b é x aa", None]))).tolist() == [1, 2, 3, -1, 0]


def test_odd_documents(spark):
    docs = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    items = [(1, "plain thea words"), (2, "日本語 12345 é日本語"), (3, None), (4, LONG), (4, "kind")]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert run(odd(spark), i) == brute(docs, items)
    assert run(empty(spark), i) == [] and run(odd(spark), i.where("false")) == [] and run(odd(spark).where("doc_id = 8"), i) == brute([(8, "12345 !!! ---")], items)
