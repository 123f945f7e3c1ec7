"""Math functions. Integers become double precision unless a scale is given;
decimals stay decimal where the result can be exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(bad: Column, state: str, message: str, value: Column) -> Column:
    """``value``, or an error with an SQLSTATE where ``bad`` is true."""
    return F.when(bad, F.raise_error(F.lit(f"{state}: {message}"))).otherwise(value)


def double(x: Column) -> Column:
    return x.cast("double")


def ceil(x: Column) -> Column:
    return double(F.ceil(x))


def floor(x: Column) -> Column:
    return double(F.floor(x))


def sqrt(x: Column) -> Column:
    return guarded(x < 0, "2201F", "cannot take square root of a negative number", F.sqrt(double(x)))


def _log_guard(x: Column, value: Column) -> Column:
    return guarded(x == 0, "2201E", "cannot take logarithm of zero", guarded(x < 0, "2201E", "cannot take logarithm of a negative number", value))


def ln(x: Column) -> Column:
    return _log_guard(x, F.ln(double(x)))


def log10(x: Column) -> Column:
    return _log_guard(x, F.log10(double(x)))


def log(x: Column, y: Column | None = None) -> Column:
    """log(x) to base 10, log(b, x) to base b."""
    return log10(x) if y is None else ln(y) / ln(x)


def round_double(x: Column) -> Column:
    """Halves to even, as for double precision."""
    return F.rint(double(x))


def round_numeric(x: Column, scale: int = 0) -> Column:
    """Halves away from zero; a negative scale rounds left of the point."""
    return F.round(x, scale)


def trunc(x: Column, scale: int = 0) -> Column:
    """Toward zero at ``scale`` digits, not below zero."""
    if scale <= 0:
        return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("decimal(38,0)")
    unit = F.lit(10**scale)
    shifted = x.cast("decimal(28,10)") * unit
    return (F.when(x >= 0, F.floor(shifted)).otherwise(F.ceil(shifted)) / unit).cast(f"decimal(38,{scale})")


def trunc_double(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def mod(a: Column, b: Column) -> Column:
    return a % b


def div(a: Column, b: Column) -> Column:
    """Quotient truncated toward zero, for decimals as well."""
    return F.when(a % b == 0, a / b).otherwise((a - a % b) / b).cast("decimal(38,0)")


def width_bucket(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    bad = (n <= 0) | (lo == hi)
    return guarded(bad, "2201G", "invalid bucket count or bounds", F.width_bucket(double(x), double(lo), double(hi), n.cast("int")).cast("int"))


def _one(f):
    return lambda x: f(double(x))


FUNCTIONS = {
    "abs": F.abs, "ceil": ceil, "ceiling": ceil, "floor": floor, "sqrt": sqrt, "exp": _one(F.exp), "ln": ln, "log": log,
    "log10": log10, "sign": _one(F.signum), "sin": _one(F.sin), "cos": _one(F.cos), "tan": _one(F.tan), "asin": _one(F.asin),
    "acos": _one(F.acos), "atan": _one(F.atan), "cbrt": _one(F.cbrt), "degrees": _one(F.degrees), "radians": _one(F.radians),
    "power": lambda a, b: F.pow(double(a), double(b)), "pow": lambda a, b: F.pow(double(a), double(b)), "round": round_numeric,
    "round_double": round_double, "trunc": trunc, "mod": mod, "div": div, "pi": F.pi, "random": F.rand, "width_bucket": width_bucket,
}
