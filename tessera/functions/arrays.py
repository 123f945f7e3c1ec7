"""Functions of one-dimensional arrays, counted from one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_length(a: Column, dimension: Column | None = None) -> Column:
    """Null for an empty array and any dimension but the first."""
    size = F.when(F.size(a) > 0, F.size(a))
    return size if dimension is None else F.when(dimension == 1, size)


def array_lower(a: Column, dimension: Column | None = None) -> Column:
    first = F.when(F.size(a) > 0, F.lit(1))
    return first if dimension is None else F.when(dimension == 1, first)


def array_append(a: Column, x: Column) -> Column:
    """A null array counts as empty."""
    return F.when(a.isNull(), F.array(x)).otherwise(F.array_append(a, x))


def array_position(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0))


def element(a: Column, i: Column) -> Column:
    """``a[i]`` from one on; null outside."""
    return F.when(i >= 1, F.get(a, i - 1))


def concat(a: Column, b: Column) -> Column:
    """Array concatenation; a null side adds nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


FUNCTIONS = {
    "array_length": array_length, "array_upper": array_length, "array_lower": array_lower, "cardinality": F.cardinality,
    "array_append": array_append, "array_position": array_position, "array_element": element, "array_cat": concat,
}
