"""Queries of the de-duplication operators over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .exact_dedup import exact_dedup
from .simhash import near_duplicates
from .substrings import drop_repeats


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_bytes")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op4_simhash_near_dedup, op5_exact_dedup, op7_substring_dedup)}

ORACLE = {
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op7_substring_dedup": r"""
        WITH worded AS (
            SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
            FROM documents
        ), started AS (
            SELECT r, doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM worded, unnest(range(1, len(ws) - 11)) AS t(i)
        ), least AS (
            SELECT win, min(doc_id) AS first FROM started GROUP BY win
        ), covered AS (
            SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM started JOIN least USING (win) WHERE first < doc_id
        ), spelled AS (
            SELECT w.r, unnest(w.ws) AS word, unnest(range(1, len(w.ws) + 1)) AS j FROM worded w
        ), kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS words FROM spelled ANTI JOIN covered USING (r, j) GROUP BY r
        )
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM worded LEFT JOIN kept USING (r)""",
}
