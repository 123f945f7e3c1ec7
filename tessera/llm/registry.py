"""All queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import queries_content, queries_dedup, queries_tables

MODULES = (queries_tables, queries_content, queries_dedup)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
