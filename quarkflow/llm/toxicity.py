"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting draws at most max_examples different labelled texts (half of either class if there are as many; a hash of the
text decides, so every labelled row may be drawn). Terms are lower-case runs of letters. All terms of the draw span
the vector space, weighted (1 + ln tf) * idf * relevance and scaled to length 1. The relevance of a term is
floor + (1 - floor) * x / (x + half), x being the chi-square statistic of its presence and the label: without it (floor
1) the vectors are plain TF-IDF, and neighbours then share prose rather than what is toxic.

The index holds, per term and block of examples, the postings and the largest weight. A search bounds every block by
the query's weights and the block maxima, opens blocks from the highest bound down, some at a time, and stops when
no closed block can reach the k-th best: the k nearest are exact. Neighbours vote with weight cos**power, times what a
row of their class stands for (classes are drawn alike, but labelled rows are not), against a prior of weight
prior_weight at the labelled rows' rate; a monotone table fitted on the examples, each left out in turn and weighted by its
class, calibrates the vote.

Defined results: null and empty texts, and texts without a term of the draw, have no neighbours and score as the prior
does; with no labelled row the score is 0. Ties in similarity go to the smaller example number. Labels other than 0
and 1, null ids and null texts are no examples; an id labelled twice is toxic if any label says so; a text that several
labelled rows share is one example, under its smallest id, and toxic if any of them is. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm.common import map_batches, materialise, schema_of, with_text

TERM = re.compile(r"[^\W\d_]+")


@dataclass
class BlockMaxIndex:
    """Examples in blocks of `block`. A term has cells, one per block that holds it: the block, the largest weight there and the postings' begin."""

    terms: dict[str, int]
    weights: np.ndarray  # idf * relevance by term
    labels: np.ndarray
    ids: np.ndarray
    block: int
    first: np.ndarray  # term: its first cell (and one more)
    cell_block: np.ndarray
    cell_max: np.ndarray
    cell_post: np.ndarray  # cell: its first posting (and one more)
    post_doc: np.ndarray
    post_weight: np.ndarray
    opened: int = field(default=0, compare=False)

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights of length 1) of a text's term counts."""
        pairs = sorted((i, n) for t, n in counts.items() if (i := self.terms.get(t)) is not None)
        at = np.array([p[0] for p in pairs], np.int64)
        w = (1 + np.log(np.array([p[1] for p in pairs], float))) * self.weights[at]
        return at, w / math.sqrt(float(w @ w)) if len(at) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine, exactly: (numbers, cosines), best first. skip: an example left out."""
        n = len(self.labels)
        if not len(at) or not n:
            return np.zeros(0, np.int64), np.zeros(0)
        cells, query = _spread(self.first[at], self.first[at + 1], w)
        blocks = self.cell_block[cells]
        # Sums run over the terms in order here and below, and each part of a bound is at least that of a cosine.
        bound = np.bincount(blocks, query * self.cell_max[cells], -(-n // self.block))
        order = np.argsort(-bound, kind="stable")
        best, sims, size, begin = np.zeros(0, np.int64), np.zeros(0), 16, 0
        while begin < len(order):
            floor = sims[-1] if len(sims) >= k else 0.0
            ask = order[begin : begin + size]
            ask = ask[np.round(bound[ask], 12) >= floor]  # cosines are told apart to 12 decimals
            if not len(ask) or bound[ask[0]] <= 0:
                break
            self.opened += len(ask)
            inside = np.zeros(len(bound), bool)
            inside[ask] = True
            chosen = inside[blocks]
            posts, x = _spread(self.cell_post[cells[chosen]], self.cell_post[cells[chosen] + 1], query[chosen])
            found = np.round(np.bincount(self.post_doc[posts], x * self.post_weight[posts], n), 12)
            if skip >= 0:
                found[skip] = 0
            here = np.flatnonzero(found > 0)
            best, sims = np.concatenate([best, here]), np.concatenate([sims, found[here]])
            top = np.lexsort((best, -sims))[:k]
            best, sims = best[top], sims[top]
            begin += size
            size *= 2
        return best, np.minimum(sims, 1.0)


def _spread(begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the ranges begin to end, each range's value repeated for its numbers)."""
    size = end - begin
    offset = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(offset - begin, size), np.repeat(values, size)


def build_index(texts: list[str], labels: list[int], ids: list[int], floor: float = 0.02, half: float = 30.0, block: int = 64) -> BlockMaxIndex:
    """Index of labelled texts over all their terms; floor and half make a term's relevance (see the module)."""
    counted = [Counter(TERM.findall(t.lower())) for t in texts]
    y = np.array(labels, np.int64)
    n, pos = len(y), int(y.sum())
    df, df_pos = Counter(), Counter()
    for c, label in zip(counted, labels):
        df.update(c.keys())
        if label:
            df_pos.update(c.keys())
    names = sorted(df)
    terms = {t: i for i, t in enumerate(names)}
    d, a = np.array([df[t] for t in names], float), np.array([df_pos[t] for t in names], float)
    scale = d * (n - d) * pos * (n - pos)
    chi2 = np.where(scale > 0, n * (a * (n - d - pos + a) - (d - a) * (pos - a)) ** 2 / np.maximum(scale, 1), 0.0)
    weights = (np.log((1 + n) / (1 + d)) + 1) * (floor + (1 - floor) * chi2 / (chi2 + half))
    none = np.zeros(0, np.int64)
    index = BlockMaxIndex(terms, weights, y, np.array(ids, np.int64), block, np.zeros(len(names) + 1, np.int64), none, np.zeros(0), np.zeros(1, np.int64), none, np.zeros(0))
    vectors = [index.vector(c) for c in counted]
    # Examples that share their weightiest term and label stand together: the block maxima bound more tightly.
    heaviest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in vectors]
    order = sorted(range(n), key=lambda i: (labels[i], heaviest[i], ids[i], i))
    index.labels, index.ids = y[order], index.ids[order]
    if not names:
        return index
    term = np.concatenate([vectors[i][0] for i in order])
    weight = np.concatenate([vectors[i][1] for i in order])
    doc = np.repeat(np.arange(n), [len(vectors[i][0]) for i in order])
    by_term = np.lexsort((doc, term))
    term, weight, doc = term[by_term], weight[by_term], doc[by_term]
    new = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] // block != doc[:-1] // block)])
    begins = np.flatnonzero(new)
    index.post_doc, index.post_weight = doc, weight
    index.cell_post = np.append(begins, len(doc))
    index.cell_block, index.cell_max = doc[begins] // block, np.maximum.reduceat(weight, begins)
    index.first = np.searchsorted(term[begins], np.arange(len(names) + 1))
    return index


@dataclass
class ToxicityModel:
    index: BlockMaxIndex
    k: int
    power: float
    prior: float
    prior_weight: float
    of_class: np.ndarray  # what an example of either class stands for
    steps: np.ndarray  # calibration: raw votes, ascending
    values: np.ndarray  # and the rates they stand for

    def raw(self, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        docs, sims = self.index.nearest(at, w, self.k, skip)
        labels = self.index.labels[docs]
        weight = sims**self.power * self.of_class[labels]
        return float((weight @ labels + self.prior_weight * self.prior) / (weight.sum() + self.prior_weight)), docs, sims

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """(calibrated score, ids of the evidence, their cosines)."""
        if not len(self.index.labels):
            return 0.0, [], []
        raw, docs, sims = self.raw(*self.index.vector(Counter(TERM.findall((text or "").lower()))))
        return float(np.interp(raw, self.steps, self.values)), self.index.ids[docs].tolist(), sims.tolist()


def _monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float, smoothing: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising table of the weighted rate of y by x, drawn to the prior a little."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight of y, weight, weighted sum of x
    for i in order:
        pools.append([float(y[i] * weight[i]), float(weight[i]), float(x[i] * weight[i])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + smoothing * prior) / (p[1] + smoothing) for p in pools])


def build_model(
    texts: list[str], labels: list[int], ids: list[int], totals: tuple[int, int] | None = None, k: int = 15, power: float = 2.0, prior_weight: float = 0.25, **options
) -> ToxicityModel:
    """totals: labelled rows of class 0 and 1 that the examples were drawn from; without them the examples are all there are."""
    index = build_index(texts, labels, ids, **options)
    drawn = np.bincount(index.labels, minlength=2)[:2] if len(labels) else np.zeros(2)
    rows = np.array(totals if totals is not None else drawn, float)
    prior = float(rows[1] / rows.sum()) if rows.sum() else 0.0
    share = np.where(drawn > 0, rows / max(rows.sum(), 1) / (np.maximum(drawn, 1) / max(drawn.sum(), 1)), 0.0)
    model = ToxicityModel(index, k, power, prior, prior_weight, share, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if drawn.min() > 0:
        of = dict(zip(ids, texts))
        raws = [model.raw(*index.vector(Counter(TERM.findall(of[i].lower()))), skip=new)[0] for new, i in enumerate(index.ids.tolist())]
        steps, values = _monotone(np.array(raws), index.labels.astype(float), share[index.labels], prior)
        model.steps, model.values = np.concatenate([[0.0], steps, [1.0]]), np.concatenate([values[:1], values, values[-1:]])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int = 3000, **options) -> ToxicityModel:
    """Fit on at most max_examples labelled texts: labels holds (id, label 0/1), docs (id, text)."""
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null and i is not null").withColumn("h", F.xxhash64("t"))
    # Texts are told apart by hash before any limit; only (id, hash) of labelled rows is shuffled.
    labelled = texts.select("i", "h").join(named, "i").groupBy("h").agg(F.max("y").alias("y"), F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    labelled = materialise(labelled, "labelled")
    totals = {r.y: r.n for r in labelled.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    drawn = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("h"), "i").limit(max_examples // 2) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).select("i", "h", "y")
    # At most max_examples rows by the limits above, so they may be broadcast: no text is shuffled for the sample.
    rows = texts.join(F.broadcast(chosen), ["i", "h"]).groupBy("i", "h").agg(F.max("y").alias("y"), F.min("t").alias("t")).orderBy("i", "h").collect()
    return build_model([r.t for r in rows], [r.y for r in rows], [r.i for r in rows], (totals.get(0, 0), totals.get(1, 0)), **options)


def score(df: DataFrame, text_col: str, model: ToxicityModel, *keep: Column, evidence: int = 3) -> DataFrame:
    """keep, score, predicted, evidence (example ids, nearest first) and evidence_cosines for every row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_examples
    kept, names, text_name = with_text(df, text_col, keep)
    schema = schema_of(kept, names, "score double, predicted int, evidence array<bigint>, evidence_cosines array<double>")

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.score(t.as_py()) for t in batch.column(text_name)]
            out = [
                pa.array([x[0] for x in found], pa.float64()),
                pa.array([int(x[0] >= 0.5) for x in found], pa.int32()),
                pa.array([x[1][:evidence] for x in found], pa.list_(pa.int64())),
                pa.array([x[2][:evidence] for x in found], pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out], names=[*names, "score", "predicted", "evidence", "evidence_cosines"])

        return work

    return map_batches(kept, make, schema)
