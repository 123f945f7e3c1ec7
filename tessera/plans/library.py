"""All queries of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from . import aggregation, bench, dml, extras, joins, predicates, scalars, scans, settings, sqltext  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
