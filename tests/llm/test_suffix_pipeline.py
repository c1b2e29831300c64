import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarkflow.llm import suffix_repeats as sr

from .oddities import empty, odd
from .test_near_duplicates import jaccard_components


def brute_groups(text, least):
    """Maximal repeats of one text with all occurrences."""
    out = set()
    for n in range(least, len(text)):
        places = {}
        for i in range(len(text) - n + 1):
            places.setdefault(text[i : i + n], []).append(i)
        for at in places.values():
            if len(at) > 1:
                left = {text[i - 1] if i else -1 for i in at}
                right = {text[i + n] if i + n < len(text) else -2 for i in at}
                if (len(left) > 1 or left == {-1}) and (len(right) > 1 or right == {-2}):
                    out.add((n, tuple(at)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)))
def test_repeat_groups_are_all_maximal_repeats(text):
    starts = np.arange(len(text))
    order, lcp = sr.enhanced_suffix_array([text], starts, np.zeros(len(text), np.int64))
    assert [text[i:] for i in order] == sorted(text[i:] for i in starts)
    before = np.array([text[i - 1] if i else -1 for i in starts], np.int64)
    got = {(n, tuple(sorted(at.tolist()))) for n, at in sr.repeat_groups(order, lcp, before, 2)}
    assert got == brute_groups(text, 2)


def brute(rows):
    """id: (bytes, removed, spans, digest) by all 50-byte strings."""
    first = {}
    for i, t in rows:
        if i is not None:
            t = (t or "").encode()
            for p in range(len(t) - 49):
                first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        if i is not None:
            for p in range(len(t) - 49):
                if first[t[p : p + 50]] < i:
                    gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), len(t) - len(kept), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, **options):
    rows = sr.remove_repeats(df, "doc_id", "text", **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"sample": 1, "hot": 2}])
def test_removal_against_brute_force(spark, options):
    random.seed(5)
    pool = ["".join(random.choice("ab cdé") for _ in range(random.randint(40, 120))) for _ in range(20)]
    noise = lambda: "".join(random.choice("xyz ") for _ in range(random.randint(1, 60)))
    rows = [(i, "".join(random.choice(pool)[random.randint(0, 30) :] if random.random() < 0.6 else noise() for _ in range(random.randint(0, 12)))) for i in range(120)]
    rows += [(300, "a" * 1000), (301, "a" * 500), (302, None), (303, ""), (304, "ab" * 300), (305, "ba" * 100), (306, rows[5][1]), (307, "é" * 60)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"), **options) == brute(rows)


def test_removal_over_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert removed(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_removal_of_odd_rows(spark):
    got = removed(odd(spark))
    assert got == brute([(r.doc_id, r.text) for r in odd(spark).collect()])
    assert sr.remove_repeats(empty(spark), "doc_id", "text").count() == 0
    texts = {r.doc_id: r.kept_text for r in sr.remove_repeats(odd(spark), "doc_id", "text", F.col("id"), F.col("spans").alias("other")).collect()}
    assert texts[2] is None and texts[3] == "" and texts[5] == ""


def test_different_spans_of_one_anchor_stay(spark):
    # One anchor in both; the spans' hashes agree in 32 bits.
    a = b"bmisqyfisoxsvlwxocusffdertkidscskuwzbouhvuxaaskaeqrqaomofglcaruotwkitqztkshl"
    b = b"hcpzkrvmknqseqrptvxbesgiudkidscskuwzbouhvuxaaskaeqdqpnlxjhcduldxbtmlgvnndzyj"
    runs = sr.runs_of([(1, 0, a), (2, 0, b)])
    assert runs.anchor[0] == runs.anchor[1] and runs.count.tolist() == [27, 27]
    rows = [(1, a.decode()), (2, b.decode())]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("large", [0, 2**62])
def test_rows_that_repeat_an_id_with_other_texts(spark, large):
    random.seed(9)
    pool = ["".join(random.choice("ab cd") for _ in range(70)) for _ in range(8)]
    rows = [(large + (random.randint(0, 30) - 15) ** 3, "".join(random.choices(pool, k=random.randint(1, 4)))) for _ in range(120)] + [(None, pool[0]), (large - 4000, pool[1] + pool[2]), (large - 4000, None)]
    for options in ({}, {"sample": 1, "hot": 2}):
        assert removed(spark.createDataFrame(rows, "doc_id long, text string"), **options) == brute(rows)


def test_equal_anchors_of_very_many_texts_are_told_apart():
    # 200,000 different spans of one anchor: no two agree in all bits, and texts that agree do.
    rng = np.random.default_rng(2)
    anchor = b"dkidscskuwzbouhvuxaaskae"
    texts = [bytes(rng.integers(97, 123, 26, dtype=np.uint8)) + anchor for _ in range(200_000)]
    r = sr.runs_of([(i, 0, t) for i, t in enumerate([*texts, texts[0]])])
    keys = set(zip(r.anchor.tolist(), r.span.tolist(), r.more.tolist()))
    assert len(keys) == len(set(texts)) and len(sr._classes(r)[2]) == len(keys)


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(sr, "_PART", 300)
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(2000))
    pieces = list(sr.pieces_of(1, text.encode()))
    assert len(pieces) > 3
    starts = sorted(p for r in [sr.runs_of(pieces)] for s, c in zip(r.start.tolist(), r.count.tolist()) for p in range(s, s + c))
    assert starts == list(range(len(text) - 49))


def test_removal_keeps_whole_characters():
    data = "aé日b".encode()
    assert sr.whole_characters(data, [(2, 5)]) == [] and sr.whole_characters(data, [(1, 6)]) == [(1, 6)] and sr.whole_characters(data, [(0, 7)]) == [(0, 7)]


# --- pipeline


def test_stages_over_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), "test")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, lang, near, repeats = seen
    assert 0.7 * len(before) < len(toxic) < len(before) and set(lang) <= set(toxic)
    assert all(toxic[i] == before[i] for i in toxic)
    rows = [(i, r.text) for i, r in lang.items()]
    _, groups = jaccard_components(rows, 5, 80)
    assert set(near) == {i for i in lang if groups[i] == i}
    want = {r[0]: r for r in brute([(i, r.text) for i, r in near.items()])}
    assert set(repeats) == set(near) and all(r.n_chars == len(r.text) for r in repeats.values())
    assert all(len(r.text.encode()) >= want[i][1] - want[i][2] for i, r in repeats.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == set(repeats)
    again = corpus_pipeline.run(spark, data).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_stages_over_odd_tables(spark, data):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns: which rows stay, stage by stage."""
    stages = dict(corpus_pipeline.STAGES)
    docs = odd(spark)
    key = lambda r: (r.doc_id, r.text)
    rows = sorted(map(key, docs.collect()), key=repr)
    clean = stages["toxicity"](spark, docs, data)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and sorted(map(key, clean.collect()), key=repr) == rows
    found = {(r.doc_id, r.text): r.lang for r in stages["language identification"](spark, docs, data).collect()}
    assert not {i for i, _ in found} & {2, 3, 8, 10}  # without a letter; all else has one of the languages that the rows are labelled with
    assert set(found.values()) <= {"en", "de", "fr"}
    near = sorted(map(key, stages["MinHash near-duplicates"](spark, docs, data).collect()), key=repr)
    # 5 repeats 4, the rows of id 6 repeat 1; the row without an id is like no other.
    want = [r for r in rows if r[0] not in (5, 6)]
    assert near == sorted(want, key=repr)
    left = {r.doc_id: r for r in stages["suffix-array repeats"](spark, docs, data).collect()}
    assert left[2].text is None and left[3].text == "" and len(left[5].text) < 100 and left[4].text != ""
    assert stages["suffix-array repeats"](spark, docs, data).count() == len(rows)
    assert stages["best-fit packing"](spark, docs, data).where("piece = 0").count() == len(rows)
    for name, stage in stages.items():
        assert stage(spark, empty(spark), data).collect() == [], name


def test_unlike_rows_of_one_id_stay(spark, data):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (1, b), (2, c), (3, b), (None, c), (None, "words of no other document at all here"), (1, a), (4, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()), key=repr)
    assert got == sorted([(1, a), (2, c), (3, b), (None, "words of no other document at all here"), (4, None), (4, "")], key=repr)


def test_toxicity_and_language_stages_equal_their_operators(spark, data):
    """What the two learned stages keep is what the operators, tested against brute force, say about each document."""
    from pyspark.sql import functions as F

    from quarkflow.llm import langid, toxicity

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = toxicity.score(docs, "text", toxicity.fit(docs, labels, "doc_id", "text", "toxic"), F.col("doc_id"))
    want = {r.doc_id for r in scored.collect() if not r.predicted}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()} == want
    found = langid.identify(docs, "text", langid.fit(docs, "doc_id", "text", "lang"), F.col("doc_id")).collect()
    want = {(r.doc_id, r.lang_pred) for r in found if r.lang_pred != langid.UNKNOWN and r.score >= corpus_pipeline.LEAST_CERTAIN}
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, docs, data).collect()} == want
