"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, licenses, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), least_bytes=0)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"]
    )


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"]
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(
        _table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), carry=["doc_id"], with_ids=False
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_best_fit_packing,
        op2_warc,
        op3_document_fingerprints,
        op4_license_scans,
        op5_quality_classifier,
        op6_ngram_jaccard_join,
        op7_token_counts,
        op8_quality_rules,
        op9_sharding,
        op10_bpe,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scans": licenses.oracle_sql()}
