"""COPY in the text and CSV forms.

Text: tab-separated (or another one-byte delimiter), ``\\N`` is null, and
backslash escapes (``\\t \\n \\r \\\\``) stand for bytes that would end a field or row.
CSV: comma-separated with double quotes doubled inside quoted fields; an unquoted
empty field is null, a quoted one an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CSV = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: What the reader gives for a quoted empty field, as against a null; a field of these two private-use characters reads as empty.
_QUOTED_EMPTY = "\ue000\ue001"


def _typed(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return raw.cast("boolean")
    return raw if isinstance(kind, T.StringType) else raw.cast(kind)


def _unescaped(field: Column) -> Column:
    """Undo backslash escapes: split at escaped backslashes first, so none is read twice."""
    part = field
    for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r")):
        part = F.replace(part, F.lit("\\" + code), F.lit(char))
    return part


def copy_from(spark: SparkSession, path: str, schema: T.StructType, form: str = "text", delimiter: str | None = None, header: bool = False) -> DataFrame:
    """Rows of a file or folder in COPY's text or CSV form, cast to ``schema``.

    A field that can't be cast, or a text row with another number of fields, fails
    when the rows are read.
    """
    if form == "csv":
        raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        rows = spark.read.schema(raw).options(**_CSV | {"emptyValue": _QUOTED_EMPTY}, sep=delimiter or ",", header=str(header).lower(), mode="FAILFAST", multiLine="true").csv(path)
        fields = ((F.when(F.col(f.name) == _QUOTED_EMPTY, "").otherwise(F.col(f.name)), f) for f in schema)
        return rows.select(*(_typed(value, f.dataType).alias(f.name) for value, f in fields))
    fields = F.split(F.col("value"), "\\Q" + (delimiter or "\t") + "\\E", -1)
    lines = spark.read.text(path).filter("value <> '\\\\.'")
    if header:
        names = (delimiter or "\t").join(schema.names)
        lines = lines.filter(F.col("value") != names)
    width = len(schema)
    rows = lines.select(F.when(F.size(fields) == width, fields).otherwise(F.raise_error(F.lit("22P04: wrong number of columns"))).alias("f"))

    def field(i: int, kind: T.DataType) -> Column:
        raw = F.get("f", F.lit(i))
        whole = F.array_join(F.transform(F.split(raw, r"\\\\", -1), _unescaped), "\\")
        return _typed(F.when(raw != "\\N", whole), kind)

    return rows.select(*(field(i, f.dataType).alias(f.name) for i, f in enumerate(schema)))


def _text(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    return F.when(value, "t").otherwise(F.when(~value, "f")) if isinstance(kind, T.BooleanType) else value.cast("string")


def copy_to(df: DataFrame, path: str, form: str = "text", delimiter: str | None = None, header: bool = False) -> None:
    """Write rows in COPY's text or CSV form, one file a partition."""
    fields = [_text(f.name, f.dataType).alias(f.name) for f in df.schema]
    if form == "csv":
        df.select(*fields).write.mode("overwrite").options(**_CSV | {"emptyValue": '""'}, sep=delimiter or ",", header=str(header).lower()).csv(path)
        return

    def escaped(value: Column) -> Column:
        for char, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            value = F.replace(value, F.lit(char), F.lit(code))
        return F.coalesce(value, F.lit("\\N"))

    df.select(F.concat_ws(delimiter or "\t", *map(escaped, fields)).alias("value")).write.mode("overwrite").text(path)
