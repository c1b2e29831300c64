"""From raw documents to packed sequences, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents (doc_id, text, lang, source, n_chars); the last returns a row per
piece of a packed sequence. Stages handle nulls in any column, empty tables, repeated rows and extra columns (which
are dropped) as their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.llm import binpack, langid, suffix_repeats, superminhash, toxicity
from quarkflow.llm.common import materialise, table
from quarkflow.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text whose language is less certain than this is no text of any of the languages.
LEAST_CERTAIN = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic, rows as they are. All rows of labels may be examples; without labels none is toxic. Null and empty texts are scored as the operator states."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "text", "toxic")
    return toxicity.score(docs, "text", model, *(F.col(c) for c in COLUMNS)).where("predicted = 0").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus is labelled with, lang being the one found; texts without a letter and uncertain ones go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, "text", model, *(F.col(c) for c in COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with `node`, a number per row: its id where that is its alone, else one beyond all ids. Of rows that repeat id and text one stays."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = materialise(ids.where("n > 1 or doc_id is null").select("doc_id"), "shared-ids")
    own = docs.withColumn("node", F.col("doc_id"))
    if shared.isEmpty():
        return own
    is_shared = docs["doc_id"].eqNullSafe(shared["doc_id"])
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    others = docs.join(shared, is_shared, "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("node", F.lit(max(most, 0) + 1) + F.monotonically_increasing_id())
    return materialise(own.join(shared, is_shared, "left_anti").unionByName(others), "told-apart")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates: five-word shingles, similarity 0.8.

    Rows that repeat an id, or have none, are documents of their own, which come after all others in no stated order; of
    those that repeat id and text one stays.
    """
    docs = _told_apart(docs.select(*COLUMNS))
    stays = materialise(superminhash.near_duplicates(docs, "node", "text", k=5, percent=80).where("kept").select("node"), "stays")
    return docs.join(stays, "node", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages (50 bytes or more) that also stand in a document of smaller id; n_chars counts what is left. Every row stays, emptied ones too; a null text stays null."""
    docs = docs.select(*COLUMNS)
    left = suffix_repeats.remove_repeats(docs, "doc_id", "text", F.col("lang"), F.col("source"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens and their places in sequences of 2048. Every row is packed, a null text as its end token alone."""
    path, pattern = vocabulary("byte_bpe_50k.json")
    return binpack.pack(binpack.tokenize(docs, "text", path, pattern, F.col("doc_id")), "doc_id", "piece")


STAGES = [
    ("toxicity", drop_toxic),
    ("language identification", identify_language),
    ("MinHash near-duplicates", drop_near_duplicates),
    ("suffix-array repeats", drop_repeats),
    ("best-fit packing", pack),
]

#: Stages learn models and follow iterative methods that SQL can't express; tests hold every stage against brute force or its operator's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
