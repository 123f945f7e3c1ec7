"""Types: names, common types, and casts whose rounding differs from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "smallint": T.ShortType(), "int2": T.ShortType(), "smallserial": T.ShortType(),
    "integer": T.IntegerType(), "int": T.IntegerType(), "int4": T.IntegerType(), "serial": T.IntegerType(), "bigint": T.LongType(),
    "int8": T.LongType(), "bigserial": T.LongType(), "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(),
    "float8": T.DoubleType(), "float": T.DoubleType(), "text": T.StringType(), "varchar": T.StringType(), "name": T.StringType(),
    "json": T.StringType(), "jsonb": T.StringType(), "bytea": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "timestamp without time zone": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(),
}

#: Numeric with no declared precision: Spark's decimals end at 38 digits.
NUMERIC = T.DecimalType(38, 16)

_RANK = [T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType]


def type_of(name: str) -> T.DataType:
    """The Spark type of a PostgreSQL type name, ``numeric(p,s)``, ``varchar(n)`` and ``t[]`` included."""
    name = re.sub(r"\s+", " ", name.strip().lower())
    if name.endswith("[]"):
        return T.ArrayType(type_of(name[:-2]))
    base, _, args = name.partition("(")
    base, sizes = base.strip(), [int(x) for x in re.findall(r"\d+", args)]
    if base in ("numeric", "decimal"):
        if sizes and sizes[0] > 38:
            raise ValueError("0A000: more than 38 digits are not supported")
        return T.DecimalType(*(sizes + [0])[:2]) if sizes else NUMERIC
    if base in ("char", "character", "bpchar"):
        return T.CharType(sizes[0] if sizes else 1)
    if base in ("varchar", "character varying"):
        return T.VarcharType(sizes[0]) if sizes else T.StringType()
    if base not in _NAMES:
        raise LookupError(f"42704: type {name!r} does not exist")
    return _NAMES[base]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that both sides of a comparison, CASE or set operation take; an error if there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    ranks = [next((i for i, k in enumerate(_RANK) if isinstance(x, k)), None) for x in (a, b)]
    if None not in ranks:
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            scale = max(a.scale, b.scale)
            return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
        if any(isinstance(x, T.DecimalType) for x in (a, b)) and max(ranks) == 3:
            decimal = a if isinstance(a, T.DecimalType) else b
            return T.DecimalType(min(38, max(decimal.precision - decimal.scale, 19) + decimal.scale), decimal.scale)
        return (a, b)[ranks[1] > ranks[0]]
    texts = (T.StringType, T.VarcharType, T.CharType)
    if isinstance(a, texts) and isinstance(b, texts):
        return T.StringType()
    times = [T.DateType, T.TimestampNTZType, T.TimestampType]
    if type(a) in times and type(b) in times:
        return (a, b)[times.index(type(b)) > times.index(type(a))]
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    raise TypeError(f"42804: types {a.simpleString()} and {b.simpleString()} cannot be matched")


def unify(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a set operation with the left names and common types."""
    if len(left.columns) != len(right.columns):
        raise ValueError("42601: each query must have the same number of columns")
    kinds = [common_type(a.dataType, b.dataType) for a, b in zip(left.schema, right.schema)]
    names = left.columns

    def cast(df: DataFrame) -> DataFrame:
        plain = df.toDF(*(f"_{i}" for i in range(len(names))))
        return plain.select(*(F.col(f"_{i}").cast(k).alias(n) for i, (k, n) in enumerate(zip(kinds, names))))

    return cast(left), cast(right)


def to_integer(x: Column, source: T.DataType, target: str = "int") -> Column:
    """Casts to integer: floats to the nearest even, decimals half away from zero."""
    if isinstance(source, (T.FloatType, T.DoubleType)):
        return F.rint(x).cast(target)
    if isinstance(source, T.DecimalType):
        return F.round(x, 0).cast(target)
    return x.cast(target)


def to_varchar(x: Column, n: int) -> Column:
    """An explicit cast: cut to n characters."""
    return F.substring(x.cast("string"), 1, n)


def assign_varchar(x: Column, n: int) -> Column:
    """An assignment: too long is an error unless only spaces would go."""
    bad = (F.char_length(x) > n) & (F.rtrim(F.substring(x, F.lit(n + 1), F.char_length(x))) != "")
    return F.when(bad, F.raise_error(F.lit(f"22001: value too long for type character varying({n})"))).otherwise(F.substring(x, 1, n))


def to_char_n(x: Column, n: int) -> Column:
    """char(n): cut and padded with spaces."""
    return F.rpad(F.substring(x.cast("string"), 1, n), n, " ")


def to_boolean(x: Column) -> Column:
    """Boolean input: any prefix of true, yes, on, false, no, off that is unique, or 1 and 0."""
    s = F.lower(F.trim(x))
    yes, no = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1"], ["f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]
    return F.when(s.isin(yes), True).when(s.isin(no), False).when(x.isNull(), None).otherwise(F.raise_error(F.lit("22P02: invalid input syntax for type boolean")).cast("boolean"))


def float_to_numeric(x: Column, kind: str = "decimal(38,15)") -> Column:
    """Fifteen significant digits of a double."""
    return F.format_string("%.14e", x.cast("double")).cast(kind)
