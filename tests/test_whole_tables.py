"""Queries over whole tables: against their SQL, and all rows there."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from tessera.plans import library

from .oracle import connect, rows_of_query, rows_of_sql

WHOLE = (
    "project_star_and_names", "comparisons", "and_or_not", "is_null", "is_true_false_unknown", "is_distinct_from", "between_symmetric", "like_ilike_escape", "row_comparison", "casts_and_rounding",
    "any_all_array", "date_arithmetic", "set_union_all", "set_union", "set_intersect", "set_intersect_all", "set_except", "set_except_all", "scalar_correlated_min", "date_trunc_units", "unnest_array",
)
KEYS = {"k": "customer", "c_custkey": "customer", "p_partkey": "part", "o_orderkey": "orders", "vec_id": "embeddings"}


@pytest.fixture(scope="module")
def folder(sf_dir):
    return os.environ.get("TEST_WHOLE_DIR", str(Path(sf_dir).parent / "sf0.01"))


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, folder, name):
    names, got = rows_of_query(library.QUERIES[name](spark, folder))
    with connect(folder) as con:
        assert (names, got) == rows_of_sql(con, library.ORACLE[name])
        for key in (n for n in names if n in KEYS and not name.startswith("scalar")):
            column = {"k": "c_custkey"}.get(key, key)
            assert len({r[names.index(key)] for r in got}) == con.execute(f"SELECT count(DISTINCT {column}) FROM {KEYS[key]}").fetchone()[0]
        if name == "scalar_correlated_min":
            assert len(got) == con.execute("SELECT count(*) FROM customer").fetchone()[0]
        if name == "set_union_all":
            assert len(got) == con.execute("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer)").fetchone()[0]
