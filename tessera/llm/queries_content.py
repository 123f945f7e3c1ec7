"""Queries of the classifier and the secret scan over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .quality import score_quality
from .secrets import find_secrets


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir)).drop("found")


QUERIES = {f.__name__: f for f in (op3_quality_classifier, op9_secret_scans)}
ORACLE: dict[str, str] = {}
