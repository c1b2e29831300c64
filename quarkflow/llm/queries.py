"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarkflow.llm import binpack, bpe, cdc, langid, lexical_search, license_scan, line_dedup, nn_descent, resampling, suffix_repeats, superminhash, toxicity, warc
from quarkflow.llm.common import fold_of, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.dedup_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def _held_out(folds: int, fold: int):
    return F.coalesce(fold_of(F.col("doc_id"), folds) == fold, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(4, 2)
    model = langid.fit(docs.where(~held_out), "doc_id", "text", "lang")
    return langid.identify(docs, "text", model, F.col("doc_id"), held_out.alias("held_out"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(5, 0)
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, "text", model, F.col("doc_id"), held_out.alias("held_out"))


def vocabulary(name: str) -> tuple[str, str]:
    """(path of a public vocabulary file, the pattern that cuts words)."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, percent=85)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.roundtrip(table(spark, sf_dir, "documents"), "text", path, pattern, F.col("doc_id"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_50k.json")
    return binpack.pack(binpack.tokenize(table(spark, sf_dir, "documents"), "text", path, pattern, F.col("doc_id")), "doc_id", "piece")


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept_text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # fmt: off
    every = (
        op1_license_scan, op2_warc_revisits, op3_language_id, op4_toxicity, op5_nn_descent, op6_super_minhash, op7_document_fingerprints, op8_byte_bpe, op9_best_fit_packing,
        op10_suffix_repeats, op11_importance_resampling, op12_line_dedup, op13_lexical_search,
    )
    # fmt: on
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle_sql(),
        "op2_warc_revisits": warc.ORACLE,
        "op5_nn_descent": nn_descent.ORACLE,
        "op6_super_minhash": superminhash.ORACLE,
        "op10_suffix_repeats": suffix_repeats.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
    }
