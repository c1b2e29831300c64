"""python -m quarkflow.cli COMMAND: the batch path over Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.operators import features, metrics, models, networks, splits, stats, training
from quarkflow.plans import workflow
from quarkflow.session import session
from quarkflow.sources import readers, shared, sinks, snapshots


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarkflow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, window: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        if window:
            c.add_argument("--lowerpt", type=float)
            c.add_argument("--upperpt", type=float)
        return c

    c = command("preprocess", "event tables to one row per selected jet")
    c.add_argument("path")
    c.add_argument("savepath")
    c.add_argument("--type", choices=("background", "signal"), required=True)
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--max-events", type=int)
    c.add_argument("--move-to-used", action="store_true")
    c = command("process", "features and background scaling of both classes")
    c.add_argument("background")
    c.add_argument("signal")
    c.add_argument("output")
    c.add_argument("--label-bg", default="background")
    c.add_argument("--label-sg", default="signal")
    c.add_argument("--filter")
    c.add_argument("--features", default="d0_sig,dz_sig,dr,log_pt")
    c.add_argument("--mask-muons", action="store_true", help="drop the signal's muons of low pt")
    c = command("train", "train a network on jets, resuming from its snapshots; scores and AUC beside them", window=False)
    c.add_argument("background")
    c.add_argument("signal")
    c.add_argument("output")
    c.add_argument("--model", choices=sorted(networks.KINDS), default="GraphAutoencoder")
    c.add_argument("--features", default="eta,phi,pt,mass", help="array columns; the first two are places")
    c.add_argument("--id", default="jet_id")
    c.add_argument("--config", type=json.loads, default={}, help="the network's sizes as JSON")
    c.add_argument("--epochs", type=int, default=10)
    c.add_argument("--steps", type=int, default=8)
    c.add_argument("--learning-rate", type=float, default=1e-2)
    c.add_argument("--weight-decay", type=float, default=1e-4)
    c.add_argument("--schedule", choices=("constant", "step", "cosine"), default="step")
    c.add_argument("--seed", type=int, default=42)
    c = command("latents", "latent numbers of jets and their principal components, from a trained network", window=False)
    c.add_argument("model")
    c.add_argument("jets")
    c.add_argument("output")
    c.add_argument("--tag", choices=snapshots.TAGS, default="best")
    c.add_argument("--features", default="eta,phi,pt,mass")
    c.add_argument("--id", default="jet_id")
    c = command("prepare", "the whole chain: preprocess every input, concat the backgrounds, process; finished steps are passed over")
    c.add_argument("signal")
    c.add_argument("backgrounds", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--features", default="d0_sig,dz_sig,dr,log_pt")
    c.add_argument("--max-events", type=int)
    c.add_argument("--mask-muons", action="store_true")
    c = command("distributions", "histograms of a column of one or more tables, over one range", window=False)
    c.add_argument("paths", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--prop", default="pt", help="a scalar column or an array, whose elements count each")
    c.add_argument("--bins", type=int, default=150)
    c.add_argument("--lower", type=float)
    c.add_argument("--upper", type=float)
    c.add_argument("--scaled-zero", type=float, help="leave out values close to this one")
    c = command("concat", "tables of one column list to one")
    c.add_argument("paths", nargs="+")
    c.add_argument("--name", required=True)
    c = command("info", "rows, columns and types of a table", window=False)
    c.add_argument("path")
    c = command("evaluate", "exact AUC and accuracy of a score table", window=False)
    c.add_argument("path")
    c = command("split", "train, val and test of a table", window=False)
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--order", required=True)
    c.add_argument("--val-fraction", type=float, default=0.1)
    c.add_argument("--test-fraction", type=float, default=0.1)
    return p


def _jets(df: DataFrame, a: argparse.Namespace, label: int) -> DataFrame:
    return training.jet_table(features.node_stack(df, features.feature_list(a.features), "_v"), a.id, F.lit(label), "_v")


def trained(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train on background (a classifier: on both classes), keep snapshots, history and test scores below the output."""
    plan = training.Plan(a.epochs, a.steps, a.learning_rate, a.weight_decay, a.schedule, seed=a.seed)
    network = networks.KINDS[a.model](len(features.feature_list(a.features)), **a.config)
    sides = [shared.written(_jets(readers.read_tables(spark, path), a, label), "jets") for label, path in enumerate((a.background, a.signal))]
    split = [shared.written(splits.three_way_split(side, "id"), "split") for side in sides]
    both = isinstance(network, networks.EdgeConvClassifier)
    part = lambda name: [s.where(F.col("split") == name).drop("split") for s in (split if both else split[:1])]
    train, val = (reduce(DataFrame.unionByName, part(name)) for name in ("train", "val"))
    if both:
        train = splits.balanced(train, "label", splits.shuffled("id", seed=a.seed), "id")
    test = reduce(DataFrame.unionByName, part("test")) if both else part("test")[0].unionByName(sides[1])
    out = training.fit_at(spark, f"{a.output}/model", network, training.dealt(train, plan), val, plan)
    scores = shared.written(training.scores(test, out.best), "scores")
    sinks.write_scores(scores, f"{a.output}/scores", "id", "label", "score")
    about = metrics.roc_auc(scores).first().asDict() | {"model": a.model, "best_epoch": out.best.about["epoch"], "history": out.history, "weights": network.size()}
    sinks.write_summary(spark, about, f"{a.output}/summary.json")
    print(json.dumps(about, indent=2))


def latents(spark: SparkSession, a: argparse.Namespace) -> None:
    """(id, label, z, pc): of all jets, from the newest snapshot."""
    z = training.latents(_jets(readers.read_tables(spark, a.jets), a, 0), snapshots.load(spark, a.model, a.tag))
    z = shared.written(z, "latents")
    first = z.first()
    size = len(first.z) if first else 0
    if size < 2:
        raise ValueError("principal components need two latent numbers and a jet")
    wide = z.withColumns({f"z{i}": F.get("z", F.lit(i)) for i in range(size)})
    rows, ratios = models.pca(wide, [f"z{i}" for i in range(size)])
    sinks.write_once(rows.select("id", "label", "z", "pc"), a.output)
    print(json.dumps({"explained_variance": ratios}))


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each step is written once: a chain that was stopped goes on where it was."""

    def once(path: str, make) -> DataFrame:
        if not sinks.is_complete(spark, path):
            sinks.write_once(make(), path)
        return spark.read.parquet(path)

    def preprocessed(path: str, name: str) -> DataFrame:
        def make() -> DataFrame:
            events = readers.read_tables(spark, path)
            events = events if a.max_events is None else readers.capped(events, a.max_events, "event_id")
            return workflow.preprocess(events, **{k: v for k, v in (("lo", a.lowerpt), ("hi", a.upperpt)) if v is not None})

        return once(f"{a.output}/preprocessed/{name}", make)

    signal = preprocessed(a.signal, "signal")
    parts = [preprocessed(path, f"background{i}") for i, path in enumerate(a.backgrounds)]
    background = once(f"{a.output}/background", lambda: workflow.concat(parts, a.lowerpt, a.upperpt))
    names = [*(f"{c}_scaled" for c in ("background", "signal")), *(f"other/{c}_{x}" for c in ("background", "signal") for x in ("rawvals", "scaledvals", "zero")), "scalers"]
    if not all(sinks.is_complete(spark, f"{a.output}/processed/{n}") for n in names):
        made = workflow.process_outputs(background, signal, tuple(features.feature_list(a.features)), a.lowerpt, a.upperpt, a.mask_muons)
        for name, df in made.items():
            once(f"{a.output}/processed/{name}", lambda df=df: df)


def distributions(spark: SparkSession, a: argparse.Namespace) -> None:
    """(dataset, bin, lo, hi, n, density): NULL, NaN and infinite values are left out; the range is that of all tables where a bound isn't given."""
    sides = []
    for i, path in enumerate(a.paths):
        df = readers.read_tables(spark, path)
        value = F.explode(a.prop) if dict(df.dtypes)[a.prop].startswith("array") else F.col(a.prop)
        sides.append(df.select(F.lit(i).alias("dataset"), value.alias("value")).withColumn("value", F.col("value").cast("double")))
    rows = reduce(DataFrame.unionByName, sides).where("not isnan(value) and abs(value) < double('infinity')")
    if a.scaled_zero is not None:
        rows = rows.where(F.abs(F.col("value") - a.scaled_zero) > 1e-4 * F.greatest(F.abs("value"), F.lit(abs(a.scaled_zero))))
    rows = shared.written(rows, "values")
    span = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    lo, hi = (given if given is not None else found for given, found in ((a.lower, span.lo), (a.upper, span.hi)))
    if lo is None or hi is None:
        raise ValueError("no values to count")
    width = F.lit((hi - lo) / a.bins)
    counted = stats.histogram(rows, "value", a.bins, "dataset", lo=lo, hi=hi)
    sinks.write_once(counted.select("dataset", "bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n", "density"), a.output)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "preprocess":
        events = readers.read_tables(spark, a.path, recursive=a.recursive)
        events = events if a.max_events is None else readers.capped(events, a.max_events, "event_id")
        window = {k: v for k, v in (("lo", a.lowerpt), ("hi", a.upperpt)) if v is not None}
        sinks.write_once(workflow.preprocess(events, **window), f"{a.savepath}/{a.type}")
        if a.move_to_used:
            sinks.move_used(spark, a.path)
    elif a.command == "process":
        tables = [readers.read_tables(spark, p, name_part=a.filter) for p in (a.background, a.signal)]
        made = workflow.process_outputs(*tables, tuple(features.feature_list(a.features)), a.lowerpt, a.upperpt, a.mask_muons, (a.label_bg, a.label_sg))
        for name, df in made.items():
            sinks.write_once(df, f"{a.output}/{name}")
    elif a.command == "prepare":
        prepare(spark, a)
    elif a.command == "distributions":
        distributions(spark, a)
    elif a.command == "train":
        trained(spark, a)
    elif a.command == "latents":
        latents(spark, a)
    elif a.command == "concat":
        sinks.write_once(workflow.concat([spark.read.parquet(p) for p in a.paths], a.lowerpt, a.upperpt), a.name)
    elif a.command == "split":
        sinks.write_table(splits.three_way_split(spark.read.parquet(a.path), a.order, a.val_fraction, a.test_fraction), a.output, "split")
    else:
        df = spark.read.parquet(a.path)
        out = workflow.info(df) if a.command == "info" else metrics.roc_auc(df).first().asDict() | metrics.accuracy(df).first().asDict()
        print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
