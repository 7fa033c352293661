"""One query for each operator, over its whole table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, centroids, dedup, divergence, fingerprints, language, licenses, mixing, pii, quality, token_files, webp
from .common import documents, scratch


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op2_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op3_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_corpus(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(documents(spark, sf_dir))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("positions")


def op7_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_column(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_documents(spark, documents(spark, sf_dir), scratch(spark, "tokens")).select("doc_id", "n_tokens")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_fingerprints, op2_pii_contexts, op3_brown_scoring, op4_near_duplicates, op5_bpe_encoding, op6_source_mixing, op7_media_webp, op8_license_scan,
        op9_language_id, op10_token_counts, op11_centroid_clustering, op12_quality_classifier, op13_source_divergence,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_token_counts": r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as n_tokens from documents",
        "op11_centroid_clustering": centroids.sql(),
        "op13_source_divergence": divergence.SQL,
    }
