import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarkflow.llm import langid, toxicity
from quarkflow.llm.queries import op3_language_id, op4_toxicity

from .oddities import empty, odd


def test_held_out_accuracy_of_language(spark, data):
    got = {r.doc_id: r for r in op3_language_id(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95


def test_words_come_before_grams_and_backoff_shortens():
    m = langid.model_of([("en", "the", 50), ("en", "house", 5), ("de", "das", 50), ("de", "haus", 5)])
    s = langid.Scorer(m)
    assert s.predict("the house")[0] == "en" and s.predict("das haus")[0] == "de"
    assert s.predict("hauses")[0] == "de"  # unseen: its grams decide
    assert s.backoff("qqq") == pytest.approx([0.0, 0.0]) or len(s.backoff("qqq")) == 2
    assert s.predict(None) == s.predict("") == s.predict("123 !") == ("und", 0.0)
    assert 0.5 <= s.predict("xyzzy")[1] <= 1


def test_words_keep_their_marks():
    import unicodedata

    assert langid.words_of("हिन्दी में") == Counter(["हिन्दी", "में"])
    apart = unicodedata.normalize("NFD", "Élève à Noël")
    assert langid.words_of(apart) == Counter(w.lower() for w in apart.split())
    assert langid.words_of("\u0301 12 ½ x\u0301y") == Counter(["x\u0301y"]) and langid.words_of("The THE a1b") == Counter({"the": 2, "a": 1, "b": 1})


def brute_language(counts, text, max_n=5):
    """(lang, score) from (lang, word, n) by the definition, with exact n-grams and no tables."""
    langs = sorted({c[0] for c in counts})
    tally = {}
    for lang, word, n in counts:
        padded = f"<{word}>"
        for kind, key in [("word", word)] + [(size, padded[i : i + size]) for size in range(1, max_n + 1) for i in range(len(padded) - size + 1)]:
            tally.setdefault(kind, {}).setdefault(key, Counter())[lang] += n

    def log(kind, key, lang):
        return math.log((tally[kind][key][lang] + 0.5) / (sum(c[lang] for c in tally[kind].values()) + 0.5 * len(tally[kind])))

    words = Counter(regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()))
    if not words:
        return "und", 0.0
    logs = dict.fromkeys(langs, 0.0)
    for word, n in words.items():
        for lang in langs:
            if word in tally["word"]:
                logs[lang] += n * log("word", word, lang)
                continue
            padded = f"<{word}>"
            longest = [next((s for s in range(max_n, 0, -1) if i + s <= len(padded) and padded[i : i + s] in tally[s]), 0) for i in range(len(padded) - 1)]
            found = [log(s, padded[i : i + s], lang) for i, s in enumerate(longest) if s]
            logs[lang] += n * (sum(found) / len(found) if found else 0.0)
    best = max(langs, key=lambda x: logs[x])
    return best, 1 / sum(math.exp((logs[x] - logs[best]) / math.sqrt(sum(words.values()))) for x in langs)


def test_language_against_brute_force(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr"), ("the ½cup is naïve²", "en"), ("straße und fluß", "de")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    counts = [(x, w, n) for x, c in ((x, Counter(regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower()))) for _, t, x in rows) for w, n in c.items()]
    texts = ["houses in gardens", "hausgarten", "jardins", "½ ² Ⅷ", "a½b", "qqq", "THE Haus la", "zzz the", "", "12 !"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    for r in langid.identify(asked, "text", model, F.col("i")).collect():
        lang, score = brute_language(counts, texts[r.i])
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9)), texts[r.i]


def test_every_word_of_the_draw_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, "doc_id", "text", "lang")
    assert set(model.words) == {w for r in docs.where("lang is not null").collect() for w in regex.findall(r"\p{L}+", (r.text or "").lower())}


@pytest.mark.parametrize("kept", [1, 3, 1000])
def test_small_tables_of_unseen_words_change_nothing(kept):
    m = langid.model_of([("en", "the", 5), ("de", "das", 5), ("de", "haus", 5)])
    text = "hauses the theme dasein thesis das aus"
    assert langid.Scorer(m, kept).predict(text) == pytest.approx(langid.Scorer(m).predict(text))


def test_language_of_odd_rows(spark):
    model = langid.fit(odd(spark), "doc_id", "text", "lang")
    rows = langid.identify(odd(spark), "text", model, F.col("doc_id"), F.col("part"), F.col("id")).collect()
    assert len(rows) == 11 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 8, 10)} == {"und"}
    assert langid.identify(empty(spark), "text", model, F.col("doc_id")).count() == 0
    none = langid.fit(empty(spark), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify(odd(spark), "text", none, F.col("doc_id")).collect()} == {"und"}


def test_a_bounded_draw_may_take_any_row(spark):
    df = spark.createDataFrame([(i, f"wort{i % 7} haus", "de") for i in range(400)], "doc_id long, text string, lang string")
    assert langid.fit(df, "doc_id", "text", "lang", max_docs=100).langs == ["de"]


def brute_vectors(texts, labels, floor=0.02, half=30.0):
    """Unit vectors by term of every text and a function for others, by the definition."""
    counted = [Counter(w for w in regex.findall(r"[^\W\d_]+", t.lower())) for t in texts]
    n, pos = len(texts), sum(labels)
    weight = {}
    for t in {t for c in counted for t in c}:
        d, a = sum(t in c for c in counted), sum(t in c and y for c, y in zip(counted, labels))
        table = d * (n - d) * pos * (n - pos)
        chi2 = n * (a * (n - pos - d + a) - (d - a) * (pos - a)) ** 2 / table if table else 0.0
        weight[t] = (math.log((1 + n) / (1 + d)) + 1) * (floor + (1 - floor) * chi2 / (chi2 + half))

    def vector(text):
        v = {t: (1 + math.log(m)) * weight[t] for t, m in Counter(regex.findall(r"[^\W\d_]+", text.lower())).items() if t in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    return [vector(t) for t in texts], vector


def labelled_texts(n=150):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    labels = [int(rng.random() < 0.4) for _ in range(n)]
    return [" ".join(rng.choice(words[:30] if y else words[20:], 12)) for y in labels], labels


@pytest.mark.parametrize("block", [3, 16, 64])
def test_block_max_search_is_exact(block):
    texts, labels = labelled_texts()
    index = toxicity.build_index(texts, labels, list(range(150)), block=block)
    vectors, vector = brute_vectors(texts, labels)
    vectors = [vectors[i] for i in index.ids]
    assert set(index.terms) == {t for v in vectors for t in v}
    for text in texts[:40] + ["", "none of these", "waa waa wab"]:
        docs, sims = index.nearest(*index.vector(Counter(toxicity.TERM.findall(text))), 7)
        own = vector(text)
        want = np.array([sum(x * v.get(t, 0.0) for t, x in own.items()) for v in vectors])
        order = [i for i in np.lexsort((np.arange(len(want)), -np.round(want, 10))) if want[i] > 1e-12][:7]
        assert np.allclose(sims, want[order], atol=1e-9) and np.allclose(want[docs], want[order], atol=1e-9)
    assert 0 < index.opened


def brute_scores(texts, labels, ids, totals, asked, k=15, power=2.0, prior_weight=0.25):
    """Calibrated scores of asked texts by the definition: all cosines, all votes, rates by the max-min formula of monotone fits."""
    vectors, vector = brute_vectors(texts, labels)
    share = [totals[y] / sum(totals) / (labels.count(y) / len(labels)) for y in (0, 1)]
    prior = totals[1] / sum(totals)

    def raw(v, skip=None):
        near = sorted(((round(sum(x * o.get(t, 0.0) for t, x in v.items()), 12), y) for j, (o, y) in enumerate(zip(vectors, labels)) if j != skip), key=lambda r: -r[0])[:k]
        weights = [(s**power * share[y], y) for s, y in near if s > 0]
        return (sum(w * y for w, y in weights) + prior_weight * prior) / (sum(w for w, _ in weights) + prior_weight)

    points = sorted((raw(v, j), labels[j]) for j, v in enumerate(vectors))
    x, y, w = np.array([p[0] for p in points]), np.array([p[1] for p in points], float), np.array([share[p[1]] for p in points])
    rate = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    pools = [np.flatnonzero(np.isclose(rate, r, atol=1e-12)) for r in sorted({round(r, 11) for r in rate})]
    steps = [np.average(x[p], weights=w[p]) for p in pools]
    values = [(y[p] @ w[p] + 0.5 * prior) / (w[p].sum() + 0.5) for p in pools]
    return [float(np.interp(raw(vector(t)), [0.0, *steps, 1.0], [values[0], *values, values[-1]])) for t in asked]


def test_scores_against_brute_force(spark):
    # Words of random weights in texts of their own: no two cosines are equal, so no tie decides.
    rng = np.random.default_rng(3)
    labels = [int(i % 3 == 0) for i in range(60)]
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    texts = [" ".join(np.repeat(c := rng.choice(words[:25] if y else words[15:], 6, replace=False), rng.integers(1, 9, 6))) for y in labels]
    ids = list(range(60))
    model = toxicity.build_model(texts, labels, ids, (900, 100))
    asked = [" ".join(rng.choice(words, 9)) for _ in range(20)] + ["", "nothing known"]
    assert [model.score(t)[0] for t in asked] == pytest.approx(brute_scores(texts, labels, ids, (900, 100), asked), abs=1e-6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert [fitted.score(t)[0] for t in asked] == pytest.approx(brute_scores(texts, labels, ids, (40, 20), asked), abs=1e-6)


def test_held_out_toxicity(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in op4_toxicity(spark, data).collect()}
    labels = [r for r in spark.read.parquet(f"{data}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in labels]) > 0.9


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("you idiot scum " if i % 2 else "a fine day ") + f"w{chr(97 + i % 5)} x") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (99, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    assert model.score("such an idiot")[0] > 0.5 > model.score("a fine walk")[0]
    assert model.score(None) == model.score("") and not math.isnan(model.score("")[0])
    assert toxicity.score(odd(spark), "text", model, F.col("doc_id"), F.col("id")).count() == 11
    assert toxicity.score(empty(spark), "text", model, F.col("doc_id")).count() == 0
    none = toxicity.fit(empty(spark), labels, "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.score(odd(spark), "text", none, F.col("doc_id")).collect()} == {0.0}


def test_repeated_rows_leave_both_classes(spark):
    rows = [(i, ("you idiot scum " if i % 2 else "a fine day ") + f"w{chr(97 + i % 5)} x{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, "doc_id", "text", "toxic", max_examples=60)
    often = toxicity.fit(spark.createDataFrame(rows * 4 + [rows[0]] * 500, "doc_id long, text string"), labels, "doc_id", "text", "toxic", max_examples=60)
    assert often.index.ids.tolist() == once.index.ids.tolist() and often.index.labels.sum() == 30
    assert often.score("such an idiot")[1:] == once.score("such an idiot")[1:]


def test_a_text_of_many_labelled_rows_is_one_example(spark):
    rows = [(i, "you idiot scum" if i < 300 else f"plain w{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, toxic int"), "doc_id", "text", "toxic", max_examples=20)
    assert model.index.labels.tolist() == [0] * 10 + [1] and model.prior == pytest.approx(0.75)
