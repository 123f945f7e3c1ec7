"""Expressions whose results differ between PostgreSQL and Spark SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncated toward zero; by zero is an error."""
    return F.call_function("div", a, b)


def numeric_div(a: Column, b: Column, scale: int = 16) -> Column:
    """Decimal division to ``scale`` digits, halves away from zero."""
    return (a.cast("decimal(38,18)") / b.cast("decimal(20,6)")).cast(f"decimal(38,{scale})")


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """True if x lies between the bounds in either order; null as the OR of both orders is."""
    return ((x >= a) & (x <= b)) | ((x >= b) & (x <= a))


def row_equal(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda p, q: p & q, (a == b for a, b in zip(left, right)))


def row_less(left: Sequence[Column], right: Sequence[Column], or_equal: bool = False) -> Column:
    """(a, b) < (c, d), column by column; null where the deciding pair has a null."""
    a, b = left[-1], right[-1]
    out = (a <= b) if or_equal else (a < b)
    for a, b in zip(reversed(left[:-1]), reversed(right[:-1])):
        out = (a < b) | ((a == b) & out)
    return out


def any_of(x: Column, array: Column, op=Column.__eq__) -> Column:
    """``x op ANY (array)``: three-valued, false for an empty array."""
    return F.exists(array, lambda e: op(x, e))


def all_of(x: Column, array: Column, op=Column.__eq__) -> Column:
    """``x op ALL (array)``: three-valued, true for an empty array."""
    return F.forall(array, lambda e: op(x, e))


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def is_false(x: Column) -> Column:
    return F.coalesce(~x, F.lit(False))


def is_unknown(x: Column) -> Column:
    return x.isNull()


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def like(x: Column, pattern: str, escape: str | None = "\\") -> Column:
    """LIKE with its escape character; none with ``escape=None``."""
    if escape is None:
        return x.rlike(_like_regex(pattern, None))
    return x.like(pattern) if escape == "\\" and "\\" not in pattern else x.rlike(_like_regex(pattern, escape))


def ilike(x: Column, pattern: str) -> Column:
    return x.ilike(pattern)


def _like_regex(pattern: str, escape: str | None) -> str:
    out, chars = [], iter(pattern)
    for c in chars:
        if c == escape:
            c = next(chars, None)
            if c is None:
                raise ValueError("22025: LIKE pattern must not end with escape character")
            out.append("\\Q" + c + "\\E")
        else:
            out.append({"%": ".*", "_": "."}.get(c, "\\Q" + c + "\\E"))
    return "(?s)\\A" + "".join(out) + "\\z"


def matches(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``~`` and ``~*``: the pattern occurs somewhere."""
    return x.rlike(("(?i)" if ignore_case else "") + pattern)


def ascending(x: Column) -> Column:
    """ASC: nulls last."""
    return x.asc_nulls_last()


def descending(x: Column) -> Column:
    """DESC: nulls first."""
    return x.desc_nulls_first()
