"""Ranked lexical search: a blocked sparse product of items x terms and terms x documents in whole numbers.

Items are dealt into blocks of a bounded number of (item, term) pairs; of each block the vocabulary and the item-term
matrix are broadcast. One pass over the documents finds the block's terms in every text (by a hash of each word,
confirmed on its bytes) and writes the term-document counts, which carry the statistics too. A second pass over these
counts makes the impacts and multiplies: each document's row of the result is merged from the item rows of its terms
(Gustavson's order), over a few hundred documents at once, and only candidates that reach the item's 50th best so far
leave the dense block. Every task ends with at most `top` rows an item; these meet in two steps, by (item, part of the
tasks), then by item.

All documents count and compete, in whole; nothing is pruned by a bound that could lose a result.

Defined results: a null text has no terms. Items without terms have no rows; rows that repeat an item_id are one item with
all their terms, and a null item_id is an item. A null doc_id is ranked as the smallest; rows that repeat an id are ranked each for
itself, equal rows in any order. An empty table of either kind gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.llm import words
from quarkflow.llm.common import materialise, mix64

#: (item, term) pairs of a block, on average; a block is broadcast.
PAIRS = 250_000
#: Cells of the dense block of results that a task fills at a time, and products that it sums up at a time (but one document's, at most the block's pairs).
CELLS = PRODUCTS = 1 << 20
#: Tasks' results are brought together in so many parts first.
PARTS = 64
_MIN = -(1 << 63)


def word_hashes(found: words.Words) -> np.ndarray:
    """64 bits of every word: sums of its bytes mixed with their places."""
    n, total = found.lengths, int(found.lengths.sum())
    before = np.cumsum(n) - n
    place = np.arange(total) - np.repeat(before, n)
    byte = found.data[np.repeat(found.starts, n) + place].astype(np.uint64)
    mixed = mix64((place.astype(np.uint64) << np.uint64(8)) | byte)
    return np.add.reduceat(mixed, before) if len(n) else np.zeros(0, np.uint64)


class Vocabulary:
    """Terms found by hash and confirmed by their bytes; of terms with equal hashes each is tried."""

    def __init__(self, terms: list[str]) -> None:
        found = words.find(pa.array(terms, pa.string()))
        if found.per_row.tolist() != [1] * len(terms):
            raise ValueError("terms must be words")
        hashes = word_hashes(found)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.data, self.starts, self.lengths = found.data, found.starts, found.lengths
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def numbers(self, found: words.Words) -> np.ndarray:
        """The number of every word's term, -1 without one."""
        out = np.full(len(found.starts), -1, np.int64)
        hashes = word_hashes(found)
        at = np.searchsorted(self.hashes, hashes)
        for step in range(self.most):
            near = at + step
            hit = np.flatnonzero((out < 0) & (near < len(self.hashes)) & (self.hashes[np.minimum(near, len(self.hashes) - 1)] == hashes))
            term = self.order[near[hit]]
            same = found.lengths[hit] == self.lengths[term]
            hit, term = hit[same], term[same]
            n = self.lengths[term]
            if not len(n):
                continue
            before = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(before, n)
            equal = found.data[np.repeat(found.starts[hit], n) + place] == self.data[np.repeat(self.starts[term], n) + place]
            equal = np.logical_and.reduceat(equal, before)
            out[hit[equal]] = term[equal]
        return out


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), once each, of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.blocks(batch, "_text"):
                found = words.find(part.column("_text"))
                data = found.data.tobytes()
                terms = [data[s : s + n].decode() for s, n in zip(found.starts.tolist(), found.lengths.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(found.rows)), pa.array(terms, pa.string())], names=["item", "term"])

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"item {kind}, term string").distinct()


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(doc, n, terms, tfs) of every document with a term: how many terms it has, and which of the vocabulary how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # a block's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        size = len(shared.value)
        for batch in batches:
            for part in words.blocks(batch, "_text"):
                found = words.find(part.column("_text"))
                term = vocabulary.numbers(found)
                known = np.flatnonzero(term >= 0)
                cell, tf = np.unique(found.rows[known] * size + term[known], return_counts=True)
                has = np.flatnonzero(found.per_row)
                row, column = cell // size, (cell % size).astype(np.int32)
                borders = pa.array(np.append(np.searchsorted(row, has), len(row)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(borders, pa.array(x.astype(np.int32))) for x in (column, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(has)), pa.array(found.per_row[has].astype(np.int64)), *lists], names=["doc", "n", "terms", "tfs"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_MIN)).alias("doc"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def merged_rows(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, first: np.ndarray, postings: np.ndarray, docs: int, items: int) -> np.ndarray:
    """items x docs: of every document the sum of its terms' item rows, each times the impact. first, postings: the items of each term."""
    n = first[term + 1] - first[term]
    total = np.zeros(items * docs, np.int64)
    before = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(before - first[term], n)
    np.add.at(total, postings[at] * docs + np.repeat(doc, n), np.repeat(impact, n))
    return total.reshape(items, docs)


class Best:
    """The `top` best (score, document) of every item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.least = np.ones(items, np.int64)  # what a score must reach: above 0, then the top-th best so far
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        item, doc, score = np.concatenate([self.item, item]), np.concatenate([self.doc, docs[at]]), np.concatenate([self.score, scores[item, at]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        start = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - start[item]
        last = rank == self.top - 1
        self.least[item[last]] = score[last]
        stays = rank < self.top
        self.item, self.doc, self.score = item[stays], doc[stays], score[stays]


def best_by_task(counts: DataFrame, weights: np.ndarray, first: np.ndarray, postings: np.ndarray, items: int, N: int, L: int, top: int) -> DataFrame:
    """(i, doc, score): of every task the best documents of each of the block's items."""
    shared = counts.sparkSession.sparkContext.broadcast((weights, first, postings))  # a block's matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, postings = shared.value
        best = Best(items, top)
        step = max(1, CELLS // items)
        for batch in batches:
            (term, n_terms), (tf, _) = flat(batch.column("terms")), flat(batch.column("tfs"))
            m, doc = 50 + 50 * batch.column("n").to_numpy() * N // L, batch.column("doc").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), n_terms)
            impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            cell = np.concatenate([[0], np.cumsum(n_terms)])  # the first term of each document
            made = np.concatenate([[0], np.cumsum(first[term + 1] - first[term])])[cell]  # products before each document
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, min(at + step, int(np.searchsorted(made, made[at] + PRODUCTS, "right")) - 1))
                here = slice(cell[at], cell[end])
                best.add(merged_rows(row[here] - at, term[here], impact[here], first, postings, end - at, items), doc[at:end])
                at = end
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], names=["i", "doc", "score"])

    return counts.mapInArrow(run, "i int, doc long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The `top` best rows of every i, with rank: parts of the tasks first, so that no task sees all tasks' rows of an item."""
    order = (F.desc("score"), F.col("doc"))
    for keys in (["i", "_part"], ["i"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("rank")
        rows = rows.select("i", "doc", "score", *(["_part"] if len(keys) > 1 else []), rank).where(F.col("rank") <= top)
    return rows.select("i", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, top: int = 50) -> DataFrame:
    """(item, rank, document, score) of the `top` best documents of every item."""
    spark = docs.sparkSession
    pairs = materialise(item_terms(items, item_col, item_text_col), "item-terms")
    kind = pairs.schema["item"].dataType.simpleString()
    blocks = -(-pairs.count() // PAIRS)
    out = spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    for block in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        listed = mine.collect()  # of PAIRS pairs on average
        if not listed:
            continue
        names = list(dict.fromkeys(r.item for r in listed))
        terms = sorted({r.term for r in listed})
        number, place = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
        cells = np.array(sorted((number[r.term], place[r.item]) for r in listed), np.int64)
        first = np.searchsorted(cells[:, 0], np.arange(len(terms) + 1))
        counts = materialise(term_counts(docs, id_col, text_col, terms), "term-counts")
        total = counts.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
        if not total.N:
            continue
        df = np.zeros(len(terms), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per term of the block
            df[r.t] = r.n
        weights = np.array([math.floor(1000 * math.log((2 * total.N + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rows = best_by_task(counts, weights, first, cells[:, 1].copy(), len(names), total.N, total.L, top)
        rows = materialise(ranked(rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS))), top), "ranked")
        key = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"i int, `{item_col}` {kind}"))  # a block's items
        out = out.unionByName(rows.join(key, "i").select(item_col, F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != _MIN, F.col("doc")).alias(id_col), "score"))
    return out


ORACLE = r"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT doc_id, ws, len(ws) AS n FROM d0 WHERE len(ws) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM d) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total WHERE term IN (SELECT term FROM items) GROUP BY term, big_n),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score FROM items JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM placed WHERE r <= 50
"""
