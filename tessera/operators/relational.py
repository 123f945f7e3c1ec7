"""Relational operators: values, series, sorting, limits, DISTINCT ON, set operations and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .types import unify


def values(spark: SparkSession, rows: Sequence[Sequence], schema: str | None = None) -> DataFrame:
    """VALUES; columns are column1, column2, ... unless a schema names them."""
    if schema is None:
        return spark.createDataFrame([tuple(r) for r in rows], [f"column{i + 1}" for i in range(len(rows[0]))])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """Integers from start to stop, stop included; nothing if the step leads away."""
    if step == 0:
        raise ValueError("22023: step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def series_of(start: Column, stop: Column, step: Column, away: Column) -> Column:
    """An array column of a series of numbers or timestamps; ``away`` says that the step leads away."""
    return F.when(away, F.slice(F.sequence(start, start, step), F.lit(1), F.lit(0))).otherwise(F.sequence(start, stop, step))


def unnest(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row for each element; none for a null or empty array."""
    return df.withColumn(name, F.explode(array))


def order_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Names sort ascending with nulls last; ``-name`` descending with nulls first."""
    out = []
    for k in keys:
        if isinstance(k, str):
            k = F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last()
        out.append(k)
    return df.orderBy(*out)


def limit_offset(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET; None is no limit; a negative number is an error."""
    if limit is not None and limit < 0:
        raise ValueError("2201W: LIMIT must not be negative")
    if offset is not None and offset < 0:
        raise ValueError("2201X: OFFSET must not be negative")
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def distinct_on(df: DataFrame, on: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group of equal ``on``, by ``order``."""
    first = Window.partitionBy(*on).orderBy(*(order or [F.col(c) for c in on]))
    return df.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = unify(a, b)
    return a.union(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = unify(a, b)
    return a.intersect(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = unify(a, b)
    return a.intersectAll(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = unify(a, b)
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = unify(a, b)
    return a.exceptAll(b)


#: Planner switches and the join hint that stands for each.
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "nested": "shuffle_replicate_nl"}


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join, with a strategy if one is asked for; else the optimizer's choice by size."""
    return left.join(right.hint(STRATEGIES[strategy]) if strategy else right, on, how)


def right_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "right")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common names, each once and first; FULL merges them by COALESCE."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """points.at within [spans.lo, spans.hi), on equal buckets of ``width`` instead of
    a nested loop; a span is in each bucket that it meets.  Whole numbers only."""
    buckets = F.explode(F.sequence(F.expr(f"floor({lo} / {width})"), F.expr(f"floor(({hi} - 1) / {width})")))
    left = points.withColumn("_bucket", F.expr(f"floor({at} / {width})"))
    right = spans.filter(F.col(lo) < F.col(hi)).withColumn("_span_bucket", buckets)
    inside = (F.col("_bucket") == F.col("_span_bucket")) & (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))
    return left.join(right, inside, how).drop("_bucket", "_span_bucket")
