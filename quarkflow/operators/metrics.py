"""Ranking metrics, exact and with ties: by distinct score, so hot scores are summed before any ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.operators.cells import before_cells, with_cell
from quarkflow.sources.shared import written


def _score_counts(scores: DataFrame, score: str, label: str) -> DataFrame:
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    return scores.where(s.isNotNull() & ~F.isnan(s) & y.isin(0, 1)).groupBy(s.alias("s")).agg(F.sum(y).cast("long").alias("p"), F.sum(1 - y).cast("long").alias("n"))


def _cumulated(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(s, p, n, tp, fp): positives and negatives at and above each score.

    Scores are cut into range cells; sums of cells come first, then running sums inside them, so no task holds all
    scores. What is counted is written, as cells, sums and running sums each read it: scores are made once.
    """
    counts = with_cell(written(_score_counts(scores, score, label), "scores"), "s", "_b")
    base = before_cells(counts.groupBy("_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")), {"_p": "_tp", "_n": "_fp"}, cell="_b", descending=True)
    inside = Window.partitionBy("_b").orderBy(F.desc("s"))
    out = counts.withColumn("_ip", F.sum("p").over(inside)).withColumn("_in", F.sum("n").over(inside)).join(F.broadcast(base), "_b")
    return out.select("s", "p", "n", (F.col("_ip") + F.col("_tp")).alias("tp"), (F.col("_in") + F.col("_fp")).alias("fp"))


def roc_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) by distinct score."""
    points = _cumulated(scores, score, label)
    totals = points.agg(F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    return points.crossJoin(F.broadcast(totals)).select(F.col("s").alias("threshold"), F.try_divide("fp", "_N").alias("fpr"), F.try_divide("tp", "_P").alias("tpr"))


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(auc, n_pos, n_neg): the chance that a positive scores above a negative, ties one half. NULL without both classes."""
    points = _cumulated(scores, score, label)
    # Negatives below a score: all but those at and above it.
    totals = points.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p").cast("double") * F.col("fp")).alias("_above"), F.sum(F.col("p").cast("double") * F.col("n")).alias("_tied"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return totals.select(F.try_divide(p * n - F.col("_above") + F.col("_tied") / 2, p * n).alias("auc"), "n_pos", "n_neg")


def accuracy(scores: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int") == F.col(label)
    return scores.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
