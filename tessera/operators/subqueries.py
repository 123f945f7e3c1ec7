"""Subquery forms that Spark SQL has no grammar for, or answers otherwise.

``summary`` is a one-row aggregate of the subquery's column, so joining it to
every outer row never multiplies them; its size is one row by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summarised(outer: DataFrame, sub: DataFrame, column: str) -> DataFrame:
    y = F.col(column)
    summary = sub.agg(F.count(F.lit(1)).alias("_n"), F.count_if(y.isNull()).alias("_nulls"), F.min(y).alias("_least"), F.max(y).alias("_most"))
    return outer.crossJoin(F.broadcast(summary))


_BOUND = {">": "_most", ">=": "_most", "<": "_least", "<=": "_least"}
_LOOSE = {">": "_least", ">=": "_least", "<": "_most", "<=": "_most"}


def _compare(x: Column, op: str, y: Column) -> Column:
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]


def compare_all(outer: DataFrame, x: Column, op: str, sub: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``x op ALL (SELECT column FROM sub)``, three-valued."""
    holds = _compare(x, op, F.col(_BOUND[op]))
    value = F.when(F.col("_n") == 0, True).when(~holds, False).when(x.isNull() | (F.col("_nulls") > 0), None).otherwise(True)
    return _summarised(outer, sub, column).withColumn(name, value).drop("_n", "_nulls", "_least", "_most")


def compare_any(outer: DataFrame, x: Column, op: str, sub: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``x op ANY (SELECT column FROM sub)``, three-valued."""
    holds = _compare(x, op, F.col(_LOOSE[op]))
    value = F.when(F.col("_n") == 0, False).when(holds, True).when(x.isNull() | (F.col("_nulls") > 0), None).otherwise(False)
    return _summarised(outer, sub, column).withColumn(name, value).drop("_n", "_nulls", "_least", "_most")


def in_as_value(outer: DataFrame, x: str, sub: DataFrame, column: str, name: str, negated: bool = False) -> DataFrame:
    """Add ``x [NOT] IN (SELECT column FROM sub)`` as a value: null where a null leaves it open."""
    found = sub.select(F.col(column).alias("_y")).filter("_y is not null").distinct().withColumn("_found", F.lit(True))
    rows = _summarised(outer, sub, column).join(found, F.col(x) == F.col("_y"), "left")
    value = F.when(F.col("_n") == 0, False).when(F.col(x).isNull(), None).when(F.col("_found"), True).when(F.col("_nulls") > 0, None).otherwise(False)
    return rows.withColumn(name, ~value if negated else value).drop("_n", "_nulls", "_least", "_most", "_y", "_found")


def array_subquery(outer: DataFrame, sub: DataFrame, on: tuple[str, str], value: str, order: str, name: str) -> DataFrame:
    """Add ``ARRAY(SELECT value FROM sub WHERE sub.on[1] = outer.on[0] ORDER BY order)``; empty where none match."""
    rows = sub.groupBy(F.col(on[1]).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias(name))
    kind = dict(rows.dtypes)[name]
    return outer.join(rows, F.col(on[0]) == F.col("_key"), "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind))).drop("_key")
