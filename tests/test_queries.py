"""Every query of the library against its SQL twin, and the analytical ones' plans."""

from __future__ import annotations

import pytest

from tessera.plans import library

from .oracle import connect, rows_of_query, rows_of_sql


@pytest.fixture(scope="module")
def duck(sf_dir):
    with connect(sf_dir) as con:
        yield con


@pytest.mark.parametrize("name", sorted(library.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    names, got = rows_of_query(library.QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_sql(duck, library.ORACLE[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert library.QUERIES[name](spark, sf_dir).count() > 0
