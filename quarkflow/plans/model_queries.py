"""Queries of models and iterative operators that SQL can't express: rows only, tested against NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarkflow.functions.expr import is_finite, significance
from quarkflow.operators import features, graphs, metrics, models, splits, stats
from quarkflow.plans import fixtures as fx
from quarkflow.plans.queries import register, rounded
from quarkflow.sources.shared import written

SUMMARY = ["pt_mean", "pt_std", "eta_std", "phi_std"]
VECTOR = ["eta", "phi", "pt", "mass"]


def summaries(spark, sf_dir) -> DataFrame:
    """Summaries of jets and their labels, written: fits, ranks and scores read them again and again."""
    p = fx.particles(spark, sf_dir)  # features row by row: nothing is nested to be laid flat again
    rows = p.withColumns({f"{c}_sig": significance(F.col(c), F.col(f"{c}_err"), F.col("pdg_id")) for c in ("d0", "dz")})
    return written(stats.jet_summary(rows).join(fx.jets(spark, sf_dir).select("jet_id", "label"), "jet_id").na.drop(), "summaries")


def vectors(spark, sf_dir) -> DataFrame:
    """(jet_id, label, x): the feature vectors of a jet's particles."""
    df = fx.nested(fx.particles(spark, sf_dir))
    return df.select("jet_id", "label", F.transform("parts", lambda p: F.array(*(p[c].cast("double") for c in VECTOR))).alias("x"))


@register()
def latent_pca(spark, sf_dir):
    """The first two principal components of the embeddings, over all their dimensions."""
    v = fx.table(spark, sf_dir, "embeddings")
    size = v.agg(F.max(F.size("embedding"))).first()[0]
    wide = v.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(size)))
    rows, _ = models.pca(wide, [f"x{i}" for i in range(size)])
    return rows.select("vec_id", F.get("pc", F.lit(0)).alias("pc0"), F.get("pc", F.lit(1)).alias("pc1"))


@register()
def linear_reconstruction_auc(spark, sf_dir):
    """Background train rows fit the encoding; the error ranks signal."""
    rows = summaries(spark, sf_dir)
    split = splits.ordered_split(rows.where("label = 0"), "jet_id")
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    scored = models.linear_reconstruction(test.unionByName(rows.where("label = 1")), train, SUMMARY, 2)
    return metrics.roc_auc(scored)


@register()
def supervised_auc(spark, sf_dir):
    rows = summaries(spark, sf_dir)
    split = written(splits.three_way_split(rows, "jet_id"), "split")
    train = written(splits.balanced(split.where("split = 'train'").drop("split"), "label", "jet_id"), "train")
    return metrics.roc_auc(models.logistic_scores(split.where("split = 'test'"), train, SUMMARY))


@register()
def hungarian_loss(spark, sf_dir):
    """Targets are a jet's particles in (eta, phi), outputs the same ones turned by a fixed angle."""
    p = fx.particles(spark, sf_dir)
    rows = p.select("jet_id", F.array("eta", "phi").alias("target"), F.array(F.col("phi") + 0.1, F.col("eta") - 0.1).alias("output"))
    return rounded(models.set_loss(rows, "jet_id", "target", "output"), "loss")


@register()
def edgeconv_scores(spark, sf_dir):
    return models.reconstruction_scores(vectors(spark, sf_dir), "jet_id", "x", models.EdgeConvEncoder(len(VECTOR)))


@register()
def latent_knn(spark, sf_dir):
    """Dynamic graphs: k nearest by the encoder's latent numbers inside each jet."""
    model = models.EdgeConvEncoder(len(VECTOR))
    df = vectors(spark, sf_dir).where("size(x) >= 2")

    def run(batches):
        for batch in batches:
            out = [None] * batch.num_rows
            for rows, x in models.stacks(batch, "x"):
                for i, z in zip(rows.tolist(), model.encode(x, models.neighbours(x[..., :2], model.k)).tolist()):
                    out[i] = z
            yield pa.RecordBatch.from_arrays([batch.column("jet_id"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["jet_id", "z"])

    latent = df.select("jet_id", "x").mapInArrow(run, "jet_id long, z array<array<double>>")
    nodes = latent.select("jet_id", F.posexplode("z").alias("idx", "v")).select("jet_id", "idx", *(F.get("v", F.lit(i)).alias(f"z{i}") for i in range(model.smallest)))
    return graphs.build(nodes, "all_features", 3, [f"z{i}" for i in range(model.smallest)])


@register()
def masked_token_loss(spark, sf_dir):
    """Masked tokens of every jet reconstructed by the token encoder; the loss is over these tokens."""
    model = models.TokenEncoder(len(VECTOR))
    p = fx.particles(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(_jet()))
    rows = p.withColumn("m", splits.token_mask("idx", "n", 0.3, "jet_id"))
    sets = rows.groupBy("jet_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.array(*(F.col(c).cast("double") for c in VECTOR)).alias("x"), "m"))).alias("t"))
    sets = sets.select("jet_id", F.col("t.x").alias("x"), F.col("t.m").alias("m"))

    def run(batches):
        for batch in batches:
            loss = np.zeros(batch.num_rows)
            masks = batch.column("m")
            masked = masks.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(masks).to_numpy(zero_copy_only=False)
            first = np.cumsum(n) - n
            for rows, x in models.stacks(batch, "x"):
                for at in range(0, len(rows), 256):
                    mine, v = rows[at : at + 256], x[at : at + 256]
                    m = masked[first[mine][:, None] + np.arange(v.shape[1])]
                    out, _ = model.forward(v, m)
                    loss[mine] = (((out - v) ** 2).mean(axis=-1) * m).sum(axis=-1) / np.maximum(1, m.sum(axis=-1))
            yield pa.RecordBatch.from_arrays([batch.column("jet_id"), pa.array(loss)], names=["jet_id", "loss"])

    return sets.mapInArrow(run, "jet_id long, loss double")


@register(f"""{fx.WITH_PARTS}, n AS (SELECT jet_id, idx, count(*) OVER (PARTITION BY jet_id) AS n, row_number() OVER (PARTITION BY jet_id ORDER BY md5('0:' || jet_id || ':' || idx), idx) AS r FROM parts)
  SELECT jet_id, idx, r <= round_even(n * 3e-1, 0) AS masked FROM n""")
def token_mask_rows(spark, sf_dir):
    """Which tokens of every jet are masked, not only how many."""
    p = fx.particles(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(_jet()))
    return p.select("jet_id", "idx", splits.token_mask("idx", "n", 0.3, "jet_id").alias("masked"))


@register(f"""{fx.WITH_PARTS}, s AS (SELECT DISTINCT jet_id, unnest(range(8)) AS slot FROM parts)
  SELECT s.jet_id, CAST(slot AS INTEGER) AS slot, coalesce(pt, 0e0) AS value, CASE WHEN pt IS NULL THEN 0 ELSE 1 END AS valid FROM s LEFT JOIN parts ON parts.jet_id = s.jet_id AND idx = slot""")
def padded_slots(spark, sf_dir):
    """Every slot of the padded arrays and its mask."""
    df = fx.nested(fx.particles(spark, sf_dir)).select("jet_id", F.transform("parts", lambda p: p["pt"]).alias("v"))
    values, mask = features.padded(F.col("v"), 8)
    return df.select("jet_id", F.posexplode(F.arrays_zip(values.alias("value"), mask.alias("valid"))).alias("slot", "s")).select("jet_id", "slot", "s.value", "s.valid")


def _jet():
    from pyspark.sql.window import Window

    return Window.partitionBy("jet_id")


@register(f"{fx.WITH_PARTS} SELECT jet_id, CAST(round_even(count(*) * 3e-1, 0) AS BIGINT) AS n_masked FROM parts GROUP BY jet_id")
def token_mask(spark, sf_dir):
    p = fx.particles(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(_jet()))
    return p.withColumn("m", splits.token_mask("idx", "n", 0.3, "jet_id")).groupBy("jet_id").agg(F.count_if("m").alias("n_masked"))


@register()
def mlp_baseline_auc(spark, sf_dir):
    """A network trained on a bounded background sample predicts pt and mass from (eta, phi); its error per jet ranks signal."""
    p = fx.particles(spark, sf_dir).where(is_finite(F.col("pt")))
    sample = models.bounded_sample(p.where("label = 0"), ["eta", "phi", "pt", "mass"], 5000, "jet_id", "idx")
    cut = int(0.8 * len(sample))
    train, val = sample[:cut], sample[cut:]
    model = models.Mlp((2, 16, 2)).fit(train[:, :2], train[:, 2:], (val[:, :2], val[:, 2:]), epochs=5)
    scored = models.network_scores(p, ["eta", "phi"], ["pt", "mass"], model, F.col("jet_id"), F.col("label"))
    return metrics.roc_auc(scored.groupBy("jet_id", "label").agg(F.avg("score").alias("score")))


@register()
def sampled_jets(spark, sf_dir):
    """A sampling operator: 100 jets at random, the same for a seed."""
    return splits.sample(fx.jets(spark, sf_dir).select("jet_id", "fj_pt"), 100, "jet_id")


@register(f"{fx.WITH_PARTS} SELECT jet_id, CAST(least(count(*), 8) AS BIGINT) AS n_valid, CAST(8 AS INTEGER) AS width FROM parts GROUP BY jet_id")
def padded_tokens(spark, sf_dir):
    df = fx.nested(fx.particles(spark, sf_dir)).select("jet_id", F.transform("parts", lambda p: p["pt"]).alias("v"))
    values, mask = features.padded(F.col("v"), 8)
    return df.select("jet_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_valid"), F.size(values).alias("width"))
