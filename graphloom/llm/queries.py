"""Queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontaminate, licences, line_quality, mixing, neardup, repeats, secrets, shared, token_bin, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.clean_lines(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through the corpus's cache in the shared folder: a later run over it encodes only what is new."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), f"{shared.shared_dir(spark)}/token-cache-{name}")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.linked_passages(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass, with their scores."""
    return classifier.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("keep")


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bin.write_tokens(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_substring_dedup,
        op3_line_quality,
        op4_token_counts,
        op5_license_scan,
        op6_decontamination,
        op7_minhash_near_dedup,
        op8_secret_scan,
        op9_quality_classifier,
        op10_token_binary,
    )
}
#: The other queries have no SQL: their methods sample, iterate, train or run a tokenizer.
ORACLE_SQL: dict[str, str] = {"op3_line_quality": line_quality.ORACLE}
