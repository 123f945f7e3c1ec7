"""A corpus pipeline: quality, exact and near de-duplication, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever they are called, as they came but for
text and n_chars of the secret scan.  An empty table gives an empty table at every
stage, a text of any length is taken whole, and of repeated rows (equal in doc_id
and text) each counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, quality, secrets, simhash
from tessera.llm.common import stash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 0 go.

    A null text scores as an empty one; a row goes by its doc_id, null or not, and its
    text, so another text of the same doc_id stays; repeated rows stay or go together.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    A null text equals an empty one; a null doc_id is less than any other; of ties
    and repeated rows one stays.
    """
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that of the least doc_id.

    Null, empty and blank texts are copies of each other; a null doc_id comes last; of
    ties the text of the least SHA-256 stays, and of repeated rows one.
    """
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are masked in its text.

    A null text stays null, and a text without secrets as it was; repeated rows are
    masked alike.  n_chars, if there, counts the masked text.
    """
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and offset.

    A null or empty text is a piece of its end mark; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
