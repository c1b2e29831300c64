"""Documents drawn so that their hashed n-gram features look like a target's: importance weights and a keyed Gumbel draw.

A feature is a run of words; its bucket is the CRC-32 of its text. Words are hashed once each and CRCs of runs are
composed (`words.run_crcs`), so no run's text is ever made, counted or shuffled. Two passes over the documents: one
counts the buckets, summed inside tasks before anything is shuffled (at most `buckets` rows a task); the other weighs
every document by the logarithm of how much likelier its features are in the target. The draw without replacement is
a top list of weights with Gumbel noise from a hash of the id, so it is the same at every run and in any partitioning.

Ranks come from a range partitioning by (eligible, score, id), never through a window without keys.

Defined results: a null text has no words. A document without words has weight 0. A null id is hashed as the empty text
and comes first among equal scores. Repeated rows are weighed, counted and drawn each for itself. An empty table gives no rows,
an empty target the weights that its smoothed counts give. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarkflow.llm import words
from quarkflow.llm.common import materialise

#: Parts of one, in which gains and noise are counted as whole numbers.
SCALE = 1000


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in words.blocks(batch, "_text"):
                for crc, _ in words.run_crcs(words.find(part.column("_text")), longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = df.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: the logarithm of its smoothed share in the target over that in the source, in whole thousandths, floored."""
    total_s, total_t, n = int(source.sum()), int(target.sum()), len(source)
    out = [math.floor(SCALE * math.log(float((t + 1) * (total_s + n)) / float((s + 1) * (total_t + n)))) for s, t in zip(source.tolist(), target.tolist())]
    return np.array(out, np.int64)


def weighted(df: DataFrame, text_col: str, gain: np.ndarray, longest: int, *keep: Column) -> DataFrame:
    """keep, n_words, n_features and weight (the floored mean gain of the row's features) of every row."""
    kept = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = kept.columns[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_words long, n_features long, weight long"])
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in words.blocks(batch, "_text"):
                found = words.find(part.column("_text"))
                n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for crc, rows in words.run_crcs(found, longest):
                    n += np.bincount(rows, minlength=part.num_rows)
                    np.add.at(total, rows, table[crc % np.uint32(len(table))])
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found.per_row.astype(np.int64)), pa.array(n), pa.array(mean)], names=[*names, "n_words", "n_features", "weight"])

    return kept.mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variate that the id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    uniform = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(uniform))).cast("long")


def ranked(df: DataFrame, eligible: Column, percent: int, *order: Column) -> DataFrame:
    """df with rank (from 1) of the first floor(percent * N / 100) of the N eligible rows in the order given, else null. df is run once."""
    spark = df.sparkSession
    rows = materialise(df.withColumn("_out", F.when(eligible, 0).otherwise(1)), "weights")  # a range partitioning reads its input twice
    dealt = rows.repartitionByRange("_out", *order).sortWithinPartitions("_out", *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranks")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in dealt.where("_out = 0").groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    base = F.broadcast(spark.createDataFrame(before or [(-1, 0)], "_p int, _before long"))
    rank = F.col("_before") + place + 1
    joined = dealt.join(base, part.cast("int") == F.col("_p"), "left")
    return joined.withColumn("rank", F.when((F.col("_out") == 0) & (rank <= percent * total // 100), rank)).drop("_out", "_at", "_p", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text_col: str, buckets: int = 10_000, longest: int = 2, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document: rank 1, 2, ... for the drawn ones, null for the others."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest))
    rows = weighted(docs, text_col, gain, longest, F.col(id_col))
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    out = ranked(rows, F.col("n_words") >= least_words, percent, F.desc("score"), F.col(id_col))
    return out.select(id_col, "n_features", "weight", "score", "rank")


# CRC-32 of a text in DuckDB: its bytes, from their hexadecimal digits, through the byte table, itself by eight shifts.
_BYTES = "list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))"
ORACLE = rf"""
WITH steps AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
lists AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS fs FROM lists),
features AS (SELECT side, id, unnest(fs) AS f FROM runs),
kinds AS (SELECT DISTINCT f FROM features),
crcs AS (SELECT f, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 10000 AS b FROM kinds, steps),
counted AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM features JOIN crcs USING (f) GROUP BY b),
totals AS (SELECT sum(s) AS ts, sum(t) AS tt FROM counted),
gain AS (SELECT b, floor(1000 * ln(CAST((t + 1) * (ts + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS g FROM counted, totals),
weights AS (SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS w FROM features JOIN crcs USING (f) JOIN gain USING (b) WHERE side = 's' GROUP BY id),
scored AS (SELECT d.id AS doc_id, n_words, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0))) AS BIGINT) AS score
    FROM runs d LEFT JOIN weights x ON x.id = d.id WHERE side = 's'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS big FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * big // 100 THEN r END AS rank FROM ordered
"""
