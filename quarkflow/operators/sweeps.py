"""Runs and sweeps: a driver loop over a grid, scores joined to runs, matching of names."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarkflow.functions.expr import d
from quarkflow.operators.metrics import roc_auc
from quarkflow.operators.splits import sweep_grid
from quarkflow.sources.sinks import exists


def run_sweep(spark: SparkSession, run: Callable[[dict], dict], **axes) -> DataFrame:
    """The grid with what run(parameters) returns for each of its rows; a run that raises stops the sweep."""
    rows = [r.asDict() for r in sweep_grid(spark, **axes).orderBy("run_idx").collect()]
    return spark.createDataFrame([r | run({k: v for k, v in r.items() if k != "run_idx"}) for r in rows])


def auc_by_run(runs: DataFrame, scores: DataFrame, run: str = "run_idx") -> DataFrame:
    """runs with auc; NULL for a run without scores of both classes. Exact, ties one half, by grouped scores per run."""
    s = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(run, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum(1 - F.col("label").cast("long")).alias("n"))
    below = F.sum("n").over(Window.partitionBy(run).orderBy("score")) - F.col("n")  # a run's distinct scores
    auc = F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p") * F.sum("n"))
    return runs.join(s.withColumn("b", below).groupBy(run).agg(auc.alias("auc")), run, "left")


def best_run(spark: SparkSession, scores_by_run: dict[int, DataFrame]) -> tuple[int, float]:
    """(run, auc) of the largest AUC, the smallest run of equals."""
    found = sorted((-(a if a is not None else -1.0), i) for i, df in scores_by_run.items() for a in [roc_auc(df).first().auc])
    return found[0][1], -found[0][0]


def best_epoch(epochs: DataFrame, *keys: str) -> DataFrame:
    """(keys, epoch, auc, loss) of the epoch kept last: a larger auc, or one as good as equal (a hundred thousandth) with a smaller loss.

    Epochs are taken in their order, as being nearly equal is not transitive; a group holds the epochs of a run. Rows
    whose auc is NULL or NaN are passed over, a NULL loss never wins; a run without others has no row.
    """
    rows = epochs.where(F.col("auc").isNotNull() & ~F.isnan("auc"))
    row = F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("auc").cast("double").alias("auc"), F.coalesce(F.col("loss").cast("double"), d(math.nan)).alias("loss"))

    def later(best: Column, x: Column) -> Column:
        near = F.abs(x["auc"] - best["auc"]) <= d(1e-8) + d(1e-5) * F.abs(best["auc"])
        return F.when((x["auc"] > best["auc"]) | (near & (x["loss"] < best["loss"])), x).otherwise(best)

    ordered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_e")).where(F.size("_e") > 0)
    return ordered.select(*keys, F.aggregate("_e", F.col("_e")[0], later).alias("_b")).select(*keys, "_b.*")


def at_setting(runs: DataFrame, **settings) -> DataFrame:
    """The runs whose parameters equal the settings (None: NULL)."""
    return runs.where(reduce(and_, (F.col(k).eqNullSafe(F.lit(v)) for k, v in settings.items()), F.lit(True)))


def with_auc(runs: DataFrame, auc: str = "auc") -> DataFrame:
    """The runs whose auc is neither NULL nor NaN."""
    return runs.where(F.col(auc).isNotNull() & ~F.isnan(auc))


def repeat_mean(rows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], repeats: int, value: str, *keys: str) -> DataFrame:
    """(keys, value): the mean over `repeats` evaluations of every row, which evaluate sees as copies told apart by `repeat`."""
    if repeats < 1:
        raise ValueError("at least one repeat")
    copies = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return evaluate(copies).groupBy(*keys).agg(F.avg(value).alias(value))


def match_names(raw: DataFrame, processed: DataFrame, raw_name: str, processed_name: str) -> DataFrame:
    """Pairs whose processed name holds the raw name: processed names are cut into substrings of the raw names' lengths, which makes it an equi-join."""
    sizes = [r[0] for r in raw.select(F.length(raw_name)).distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("raw names of more than 1000 lengths")
    n, none = F.length(processed_name), F.array().cast("array<int>")
    found = None
    for size in (s for s in sizes if s):
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(none)
        cut = processed.withColumn("_i", F.explode(starts)).withColumn("_part", F.col(processed_name).substr(F.col("_i"), F.lit(size))).drop("_i")
        found = cut if found is None else found.unionByName(cut)
    if found is None:
        return raw.join(processed, F.lit(False))
    return raw.join(found.distinct(), F.col(raw_name) == F.col("_part")).drop("_part")


# --- successive halving ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Halving:
    """Rungs at grace, grace * factor, ... epochs up to `epochs`; at each the best 1/factor of the trials (one at least) goes on."""

    epochs: int
    grace: int = 1
    factor: int = 2

    def __post_init__(self) -> None:
        if self.factor < 2 or not 1 <= self.grace <= self.epochs:
            raise ValueError("a factor of 2 or more, and grace epochs from 1 to all of them")

    def rungs(self) -> list[int]:
        out = [self.grace]
        while out[-1] < self.epochs:
            out.append(min(self.epochs, out[-1] * self.factor))
        return out


_RUNGS = "trial int, rung int, epochs int, value double, setting string"


def halving_sweep(spark: SparkSession, path: str, grid: list[dict], run: Callable[[int, dict, int], float], halving: Halving, at_once: int = 2) -> DataFrame:
    """The rung table (trial, rung, epochs, value, setting): what every trial reached at every rung it came to, larger values being better.

    run(trial, setting, epochs) brings a trial to that many epochs, from its own snapshot where it has one, and returns
    its value. Trials of a rung run as concurrent Spark jobs, at_once of them. Each result is written to the rung table on
    shared storage as soon as it is there, and what is in the table is not run again: a stopped sweep goes on where it was.
    A sweep of other settings in the same folder is an error. NaN and NULL values are the worst; equal ones go by trial.
    """
    written = [json.dumps(s, sort_keys=True) for s in grid]
    if not written:
        raise ValueError("a sweep needs a trial")
    folder = f"{path.rstrip('/')}/rungs"
    done: dict[tuple[int, int], float] = {}
    if exists(spark, folder):
        for r in spark.read.schema(_RUNGS).parquet(folder).collect():  # a row per trial and rung
            if r.trial >= len(written) or written[r.trial] != r.setting:
                raise ValueError(f"{folder} holds another sweep")
            done[r.trial, r.rung] = r.value

    alive, writing = list(range(len(grid))), Lock()  # appends to one folder share its staging folder
    rungs = halving.rungs()
    for rung, epochs in enumerate(rungs):

        def one(trial: int, rung: int = rung, epochs: int = epochs) -> None:
            value = run(trial, grid[trial], epochs)
            row = spark.createDataFrame([(trial, rung, epochs, None if value is None else float(value), written[trial])], _RUNGS)
            with writing:
                row.coalesce(1).write.mode("append").parquet(folder)
            done[trial, rung] = value

        left = [t for t in alive if (t, rung) not in done]
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(left) or 1))) as pool:
            list(pool.map(inheritable_thread_target(spark)(one) if left else one, left))
        if rung + 1 < len(rungs):
            alive = promoted({t: done[t, rung] for t in alive}, halving.factor)
    return spark.read.schema(_RUNGS).parquet(folder)


def promoted(values: dict[int, float | None], factor: int) -> list[int]:
    """The best 1/factor of the trials, one at least, in order of their numbers."""
    worst = lambda v: v is None or v != v
    order = sorted(values, key=lambda t: (worst(values[t]), 0.0 if worst(values[t]) else -values[t], t))
    return sorted(order[: max(1, len(order) // factor)])


def winner(rungs: DataFrame) -> DataFrame:
    """The row of the trial that came furthest with the largest value, the smaller number of equals."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return rungs.orderBy(F.desc("epochs"), F.desc_nulls_last(value), "trial").limit(1)
