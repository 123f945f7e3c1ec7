"""Rows of a query and of its SQL twin in one comparable form."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with a view on each table of the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value) -> str:
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(round(float(value), 6) + 0.0)  # no negative zero
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return f"{value.isoformat()}T00:00:00"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(plain, value))}]"
    return str(value)


def rows(names: list[str], found) -> tuple[list[str], list[tuple[str, ...]]]:
    """Column names in order, and the sorted rows with their values in that order."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in found)


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str):
    found = con.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())


def rows_of_query(df):
    return rows(df.columns, df.collect())
