"""The registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import TABLES, register_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return keep


def both(name: str, spark_sql: str, other_sql: str | None = None, **args) -> None:
    """Register a Spark SQL text; ``other_sql`` is its twin where the dialects differ."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register_views(spark, folder, *(t for t in TABLES if t in spark_sql))
        return spark.sql(spark_sql, args=args) if args else spark.sql(spark_sql)

    run.text = spark_sql
    QUERIES[name] = run
    ORACLE[name] = other_sql or spark_sql
