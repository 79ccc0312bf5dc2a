"""The registered queries op1 to op10: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, neardup, packing, quality, secrets, sharding, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    trees = langid.fit(docs.select("doc_id", "text", "lang"), ~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))
    return langid.identify(docs, trees)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and grade of every document, from the labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a null text has none."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each license found in the documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard if there were one more."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark passage found in the documents."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, and which one of it is kept."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.assess(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_secrets, op4_licenses, op5_token_counts, op6_sharding, op7_packing, op8_decontamination, op9_near_duplicates, op10_quality)}


def oracle_sql() -> dict[str, str]:
    """Of these ten only the quality rules can be written in SQL; the others are tested against brute force."""
    return {"op10_quality": quality.oracle_sql()}
