"""Language identification by words first, then shorter and shorter character n-grams.

Fitting: labelled rows are thinned by a hash of id and text to about max_docs documents (a documented bound on the
labelled rows; every row may be drawn), and all their words are counted per language. A word is a run of letters and of
marks after them, by one function for fitting and prediction. A word of the draw scores by its log frequency in each language; an unseen word is
read from left to right, at each place by the longest n-gram of the draw's words that starts there, from max_n
characters down to one. A text's score is the sum over all its words. No word or n-gram of the draw is left out.

Defined results: a null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts
first. With no labelled row every text is `und`. Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import map_batches, mix64, schema_of, with_text

#: A word: letters, with the marks that are combined with them. The first pattern is the same for ASCII texts.
_ASCII, _WORD = re.compile("[a-z]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


def words_of(text: str) -> Counter[str]:
    """Lower-case words of a text with their numbers."""
    text = text.lower()
    return Counter((_ASCII if text.isascii() else _WORD).findall(text))


@dataclass
class LanguageModel:
    """langs in order; words and grams map to rows of log probabilities by language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    max_n: int


def word_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over labelled rows, with partial sums before the shuffle."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found: dict[str, Counter[str]] = {}
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                found.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            columns = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            if not columns:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        return work

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = 8_000, max_n: int = 5) -> LanguageModel:
    """Fit on about max_docs labelled rows of df (null text or language is no label)."""
    labelled = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    total = labelled.count()
    if total > max_docs:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < int(max_docs / total * (1 << 30)))
    return model_of_table(word_counts(labelled, text_col, lang_col).orderBy("word", "lang").toArrow(), max_n)


def _logs(counts: np.ndarray) -> np.ndarray:
    """Smoothed log shares of rows within each column."""
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts)))) if counts.size else counts


def model_of(counts: list[tuple[str, str, int]], max_n: int = 5) -> LanguageModel:
    """The model of (lang, word, n) triples."""
    return model_of_table(pa.table({c: pa.array([x[i] for x in counts], t) for i, (c, t) in enumerate((("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())))}), max_n)


#: N-grams of one size are counted in so many parts, by hash: the driver holds the temporary arrays of one.
PARTS = 16


def model_of_table(counts: pa.Table, max_n: int = 5) -> LanguageModel:
    """The model of a table (lang, word, n). What is built on the way is of the draw's size, not more than a few times the model's."""
    coded = {c: counts.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word")}
    found = coded["lang"].dictionary.to_pylist()
    langs = sorted(found)
    lang = np.array([langs.index(x) for x in found], np.int64)[coded["lang"].indices.to_numpy()]
    words = {w: i for i, w in enumerate(coded["word"].dictionary.to_pylist())}
    table = np.zeros((len(words), len(langs)))
    np.add.at(table, (coded["word"].indices.to_numpy(), lang), counts.column("n").to_numpy().astype(float))
    del coded, lang
    # All words in one string, each between its marks: the n-grams of one size are its windows inside words.
    joined = "".join([f"<{w}>" for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    letters = mix64(np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64))
    grams: dict[str, int] = {}
    logs = [np.zeros((0, len(langs)))]
    window = letters
    for size in range(1, max_n + 1):
        if size > 1:
            window = mix64(window[:-1] * np.uint64(3)) + letters[size - 1 :]
        if not len(window):
            break
        inside = owner[: len(window)] == owner[size - 1 :]
        sums = []
        for part in range(PARTS):
            at = np.flatnonzero(inside & (window % np.uint64(PARTS) == part)).astype(np.int32 if len(window) < 1 << 31 else np.int64)
            _, first, number = np.unique(window[at], return_index=True, return_inverse=True)
            if len(first):
                sums.append(np.stack([np.bincount(number, table[owner[at], k], len(first)) for k in range(len(langs))], axis=1))
                for i in at[first].tolist():
                    grams[joined[i : i + size]] = len(grams)
        if sums:
            logs.append(_logs(np.concatenate(sums)))
    return LanguageModel(langs, words, _logs(table), grams, np.concatenate(logs), max_n)


class Scorer:
    """Predicts one text after another; unseen words' scores are kept in a bounded table."""

    def __init__(self, model: LanguageModel, kept_words: int = 50_000):
        self.m, self.kept_words = model, kept_words
        self.rows = np.concatenate([model.word_logs.reshape(len(model.words), len(model.langs)), np.zeros((kept_words, len(model.langs)))])
        self.unseen: dict[str, int] = {}

    def backoff(self, word: str) -> list[float]:
        """An unseen word's score: the mean over its places of the longest known n-gram that starts there."""
        padded = f"<{word}>"
        found, grams = [], self.m.grams
        for i in range(len(padded) - 1):
            for size in range(min(self.m.max_n, len(padded) - i), 0, -1):
                if (g := grams.get(padded[i : i + size])) is not None:
                    found.append(g)
                    break
        return self.m.gram_logs[found].mean(axis=0).tolist() if found else [0.0] * len(self.m.langs)

    def row(self, word: str) -> int:
        """The place of a word that is not in the model among the scores."""
        if (i := self.unseen.get(word)) is None:
            i = self.unseen[word] = len(self.m.words) + len(self.unseen)
            self.rows[i] = self.backoff(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.m.langs:
            return UNKNOWN, 0.0
        counts = words_of(text)
        if not counts:
            return UNKNOWN, 0.0
        logs, words = np.zeros(len(self.m.langs)), list(counts)
        n = np.fromiter(counts.values(), float, len(counts))
        for at in range(0, len(words), self.kept_words):  # one step but for texts of very many words
            some = words[at : at + self.kept_words]
            places = list(map(self.m.words.get, some))
            new = [i for i, p in enumerate(places) if p is None]
            if len(self.unseen) + len(new) > self.kept_words:
                self.unseen.clear()
            for i in new:
                places[i] = self.row(some[i])
            logs += n[at : at + len(some)] @ self.rows[places]
        best = int(np.argmax(logs))  # the first of equals: langs are sorted
        # Words of a text depend on each other: the posterior is that of the square root of their number.
        p = np.exp((logs - logs[best]) / math.sqrt(n.sum()))
        return self.m.langs[best], float(1 / p.sum())


def identify(df: DataFrame, text_col: str, model: LanguageModel, *keep: Column) -> DataFrame:
    """keep, lang_pred and score for every row of df; only the text is read for the prediction."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_docs
    kept, names, text_name = with_text(df, text_col, keep)
    schema = schema_of(kept, names, "lang_pred string, score double")

    def make():
        scorer = Scorer(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.predict(t.as_py()) for t in batch.column(text_name)]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=[*names, "lang_pred", "score"])

        return work

    return map_batches(kept, make, schema)
