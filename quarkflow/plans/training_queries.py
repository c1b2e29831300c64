"""Queries of trained networks: they train on the given tables by distributed gradient steps, so they have rows only; tests hold gradients, steps and losses against NumPy.

The tables' own labels are random, so there is a label to learn: a jet is signal if two of its particles lie within CLOSE in (eta, phi). No
summary of a jet's features tells that, its graph does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.functions.expr import d
from quarkflow.operators import metrics, models, networks, splits, stats, sweeps, training
from quarkflow.plans import fixtures as fx
from quarkflow.plans.model_queries import SUMMARY, VECTOR
from quarkflow.plans.queries import featured, flat, register
from quarkflow.sources.shared import shared_path, written

CLOSE = 0.21
#: Slots of the class-token autoencoder at least; a table with a larger jet has as many as that jet's particles.
SLOTS = 16


def jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, label, x): jets of two particles and more, written: splits and steps read them again and again."""
    df = fx.nested(fx.particles(spark, sf_dir), *VECTOR).where("size(parts) >= 2")

    def near(p, q):
        x, y = p["eta"] - q["eta"], p["phi"] - q["phi"]
        return (q["idx"] > p["idx"]) & (x * x + y * y <= d(CLOSE * CLOSE))

    signal = F.exists("parts", lambda p: F.exists("parts", lambda q: near(p, q))).cast("int")
    vectors = F.transform("parts", lambda p: F.array(*(p[c].cast("double") for c in VECTOR)))
    return written(training.jet_table(df.select("jet_id", signal.alias("label"), vectors.alias("v")), "jet_id", "label", "v"), "jets")


def sides(rows: DataFrame, plan: training.Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test) of three_way_split, written; train is dealt into the plan's steps. Where ids part the sides, rows are compared with two of them; else they are ranked."""
    borders = splits.three_way_borders(rows, "id")
    if borders:
        first, last = (F.lit(b) for b in borders)
        held = written(rows.where(F.col("id") > first), "held")
        return training.dealt(rows.where(F.col("id") <= first), plan), held.where(F.col("id") <= last), held.where(F.col("id") > last)
    split = written(splits.three_way_split(rows, "id"), "split")
    one = lambda name: split.where(F.col("split") == name).drop("split")
    return training.dealt(one("train"), plan), one("val"), one("test")


def anomaly(spark: SparkSession, sf_dir: str, network: networks.Network, plan: training.Plan) -> tuple[training.Trained, DataFrame]:
    """(trained on background alone, background test jets and all signal jets)."""
    rows = jets(spark, sf_dir)
    train, val, test = sides(rows.where("label = 0"), plan)
    trained = training.fit(network, train, val, plan)
    return trained, test.unionByName(rows.where("label = 1"))


@register()
def edgeconv_classifier_auc(spark, sf_dir):
    """Test AUC of the trained graph classifier, and of a logistic regression on the summaries of the same training and test jets."""
    plan = training.Plan(epochs=8, steps=8, rate=3e-2)
    train, val, test = sides(jets(spark, sf_dir), plan)
    trained = training.fit(networks.EdgeConvClassifier(len(VECTOR), smallest=8, k=4, reduced_k=4), train, val, plan)
    network = metrics.roc_auc(training.scores(test, trained.best)).withColumn("model", F.lit("edgeconv"))
    summary = written(stats.jet_summary(flat(featured(spark, sf_dir), "label").drop("label")).na.drop(), "summaries")  # read by fit and by scores
    both = [side.select(F.col("id").alias("jet_id"), "label").join(summary, "jet_id") for side in (train, test)]
    linear = metrics.roc_auc(models.logistic_scores(both[1], both[0], SUMMARY)).withColumn("model", F.lit("logistic"))
    return network.unionByName(linear).select("model", "auc", "n_pos", "n_neg")


GRAPH = {"width": 8, "smallest": 2, "layers": 2, "k": 3}
TOKENS = {"width": 8, "layers": 1, "heads": 2, "dropout": 0.1}


@register()
def graph_autoencoder_history(spark, sf_dir):
    """(epoch, rate, train_loss, val_loss) of the graph autoencoder on background jets."""
    plan = training.Plan(epochs=4, steps=4, rate=1e-2, every=2)
    trained, _ = anomaly(spark, sf_dir, networks.GraphAutoencoder(len(VECTOR), **GRAPH), plan)
    return training.history_table(spark, trained)


@register()
def graph_autoencoder_scores(spark, sf_dir):
    """(jet_id, label, score): reconstruction errors from the weights of the best validation loss, of background test jets and all signal jets."""
    trained, test = anomaly(spark, sf_dir, networks.GraphAutoencoder(len(VECTOR), **GRAPH), training.Plan(epochs=4, steps=4, rate=1e-2))
    return training.scores(test, trained.best).withColumnRenamed("id", "jet_id")


def _slot_auc(spark, sf_dir, loss: str) -> DataFrame:
    rows = jets(spark, sf_dir)
    slots = max(SLOTS, rows.agg(F.max(F.size("x"))).first()[0] or 0)
    plan = training.Plan(epochs=3, steps=4, rate=5e-3, schedule="cosine")
    train, val, test = sides(rows.where("label = 0"), plan)
    network = networks.ClassTokenAutoencoder(len(VECTOR), **TOKENS, latent=4, slots=slots, loss=loss)
    trained = training.fit(network, train, val, plan)
    return metrics.roc_auc(training.scores(test.unionByName(rows.where("label = 1")), trained.best))


@register()
def class_token_set_auc(spark, sf_dir):
    """Test AUC of the class-token autoencoder trained by the matched loss: slots and particles are matched in every gradient step."""
    return _slot_auc(spark, sf_dir, "set")


@register()
def class_token_index_auc(spark, sf_dir):
    """The same by the loss of slot i against particle i."""
    return _slot_auc(spark, sf_dir, "index")


@register()
def token_autoencoder_auc(spark, sf_dir):
    """Test AUC of the token-to-token autoencoder."""
    plan = training.Plan(epochs=3, steps=4, rate=5e-3, schedule="cosine")
    trained, test = anomaly(spark, sf_dir, networks.TokenAutoencoder(len(VECTOR), **TOKENS, latent=4), plan)
    return metrics.roc_auc(training.scores(test, trained.best))


@register()
def masked_transformer_auc(spark, sf_dir):
    """Test AUC of the masked transformer of two blocks: masks are drawn anew in each step, and a jet's score is its mean over three masks."""
    plan = training.Plan(epochs=3, steps=4, rate=5e-3, schedule="cosine")
    network = networks.MaskedTransformer(len(VECTOR), **TOKENS | {"layers": 2}, ratio=0.5)
    trained, test = anomaly(spark, sf_dir, network, plan)

    def evaluate(copies: DataFrame) -> DataFrame:
        return training.scores(copies.withColumn("key", F.xxhash64("id", "repeat")), trained.best)

    return metrics.roc_auc(sweeps.repeat_mean(test, evaluate, 3, "score", "id", "label"))


@register()
def trained_latents(spark, sf_dir):
    """(jet_id, label, pc0, pc1): principal components of the class-token latents of all jets, encoded once from a saved snapshot."""
    rows = jets(spark, sf_dir)
    plan = training.Plan(epochs=2, steps=4, rate=5e-3, schedule="cosine")
    path = shared_path(spark, "token-autoencoder")
    train, val, _ = sides(rows.where("label = 0"), plan)
    training.fit_at(spark, path, networks.TokenAutoencoder(len(VECTOR), **TOKENS, latent=4), train, val, plan)
    z = training.latent_table(rows, path)
    wide = z.select(F.col("id").alias("jet_id"), "label", *(F.get("z", F.lit(i)).alias(f"z{i}") for i in range(4)))
    return models.pca(wide, [f"z{i}" for i in range(4)])[0].select("jet_id", "label", F.get("pc", F.lit(0)).alias("pc0"), F.get("pc", F.lit(1)).alias("pc1"))


@register()
def halved_sweep(spark, sf_dir):
    """The rung table of a sweep over the classifier's rate and size by successive halving, validation AUC deciding; trials go on from their snapshots."""
    path = shared_path(spark, "sweep")
    plan = training.Plan(epochs=4, steps=4)
    train, val, _ = sides(jets(spark, sf_dir), plan)
    grid = [{"rate": r, "smallest": s} for r in (3e-2, 1e-3) for s in (8, 16)]

    def run(trial: int, setting: dict, epochs: int) -> float:
        network = networks.EdgeConvClassifier(len(VECTOR), smallest=setting["smallest"], k=4, reduced_k=4)
        trained = training.fit_at(spark, f"{path}/trial={trial}", network, train, val, replace(plan, rate=setting["rate"]), epochs)
        return metrics.roc_auc(training.scores(val, trained.last)).first().auc

    return sweeps.halving_sweep(spark, path, grid, run, sweeps.Halving(4, 1, 2))
