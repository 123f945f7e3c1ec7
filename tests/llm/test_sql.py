"""Queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from tessera.llm import registry

from ..oracle import connect, rows_of_query, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    names, got = rows_of_query(registry.queries()[name](spark, sf_dir))
    with connect(sf_dir) as duck:
        assert (names, got) == rows_of_sql(duck, registry.oracle_sql()[name])
