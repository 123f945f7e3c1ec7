"""Aggregates with PostgreSQL's result types and null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filtered(x: Column, condition: Column) -> Column:
    """The argument of an aggregate with FILTER (WHERE condition)."""
    return F.when(condition, x)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_exact(x: Column, kind: str = "decimal(38,0)") -> Column:
    """sum of bigint or numeric: numeric, so it can't overflow 64 bits."""
    return F.sum(x.cast(kind))


def avg_exact(x: Column, scale: int = 16, kind: str = "decimal(22,2)") -> Column:
    """avg of integers or numeric: numeric with at least 16 digits after the point."""
    total = F.sum(x.cast(kind))
    return (total.cast("decimal(38,18)") / F.count(x).cast("decimal(20,0)")).cast(f"decimal(38,{scale})")


def array_agg(x: Column, *order: Column) -> Column:
    """Keeps nulls; null for no rows; ordered by ``order`` (ascending, nulls last)."""
    keys = [F.struct(k.isNull().alias("n"), k.alias("k")).alias(f"k{i}") for i, k in enumerate(order)]
    rows = F.collect_list(F.struct(*keys, x.alias("x")))
    rows = F.transform(F.array_sort(rows) if order else rows, lambda r: r["x"])
    return F.when(F.size(rows) > 0, rows)


def array_agg_distinct(x: Column) -> Column:
    """Distinct values in order, a null last."""
    values = F.array_sort(F.collect_set(x))
    with_null = F.when(F.max(x.isNull()), F.concat(values, F.array(F.lit(None)))).otherwise(values)
    return F.when(F.size(with_null) > 0, with_null)


def string_agg(x: Column, sep: str, *order: Column) -> Column:
    """Nulls are left out; null if nothing is left; ordered by ``order`` (ascending, nulls last)."""
    keys = [F.struct(k.isNull().alias("n"), k.alias("k")).alias(f"k{i}") for i, k in enumerate(order)]
    rows = F.collect_list(F.when(x.isNotNull(), F.struct(*keys, x.cast("string").alias("x"))))
    rows = F.transform(F.array_sort(rows) if order else rows, lambda r: r["x"])
    return F.when(F.size(rows) > 0, F.array_join(rows, sep))


AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "bool_and": F.bool_and, "every": F.every,
    "bool_or": F.bool_or, "string_agg": string_agg, "array_agg": array_agg, "variance": F.variance, "var_samp": F.var_samp,
    "var_pop": F.var_pop, "stddev": F.stddev, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop,
}
