"""Queries on tables of what only larger ones hold, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from tessera.operators import tables
from tessera.plans import library

from .oracle import connect, rows_of_query, rows_of_sql


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name: str, table: str, sql: str) -> None:
        duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
        got = rows_of_query(library.QUERIES[name](spark, str(tmp_path)))
        with connect(str(tmp_path)) as con:
            assert got == rows_of_sql(con, library.ORACLE[name])

    return check


def test_customers_with_the_numbers_of_new_rows(same_as_sql):
    same_as_sql("on_conflict_do_update", "customer", "SELECT i * 50000 AS c_custkey, 'c' || i AS c_name, CAST(i % 3 AS INTEGER) AS c_nationkey, i * 10.5 - 40 AS c_acctbal FROM range(19) t(i)")


def test_statistics_of_more_customers_than_a_sample(same_as_sql):
    same_as_sql("analyze_statistics", "customer", "SELECT i AS c_custkey, 'c' || i % 31000 AS c_name, CAST(nullif(i % 9, 4) AS INTEGER) AS c_nationkey, i * i % 30011 / 4.0 AS c_acctbal FROM range(34567) t(i)")


@pytest.mark.parametrize("few", [0, 30_000])
def test_statistics_of_all_rows(spark, tmp_path, monkeypatch, few):
    """Bounds and common values, by either way, as from a sorted list."""
    monkeypatch.setattr(tables, "SAMPLE", few)
    db = tables.Database(spark, str(tmp_path / "db"))
    db.create_table_as("t", spark.sql("SELECT id * 37 % 35000 AS spread, IF(id % 5 = 0, NULL, CAST(id * id % 97 AS DOUBLE)) AS some, array(id % 2) AS pair, CAST(NULL AS INT) AS none FROM range(35000)"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of values
    try:
        about = {a["column"]: a for a in db.analyze("t")}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    some = sorted(float(i * i % 97) for i in range(35000) if i % 5)
    assert about["spread"]["bounds"] == [float(min(34999, j * 1750)) for j in range(21)] and about["spread"]["n_distinct"] == 35000
    assert about["some"]["bounds"] == [some[min(27999, j * 1400)] for j in range(21)] and about["some"]["null_frac"] == 0.2
    assert about["some"]["common"] == sorted(((v, some.count(v)) for v in {*some}), key=lambda vc: (-vc[1], vc[0]))[:10]
    assert about["pair"]["common"] == [((0,), 17500), ((1,), 17500)]
    assert about["none"] == {"column": "none", "null_frac": 1.0, "n_distinct": 0, "common": [], "bounds": None}
    assert not [p for p in (tmp_path / "db").glob("t-*/*-counts")]


def test_events_at_half_seconds(same_as_sql):
    same_as_sql("extract_fields", "events", "SELECT i AS event_id, TIMESTAMP '1969-12-31 23:59:52.000001' + to_microseconds(i * 499999 + i // 2) AS ts FROM range(64) t(i) UNION ALL SELECT 64 + i, TIMESTAMP '2024-02-29 12:00:00.5' + to_seconds(i) FROM range(20) t(i)")
