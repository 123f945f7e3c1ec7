"""Scalar functions with PostgreSQL's results, as Column builders.

``call("name", *columns)`` looks a function up by its SQL name.
"""

from __future__ import annotations

from pyspark.sql import Column

from . import arrays, datetimes, maths, strings, system

FUNCTIONS = {**maths.FUNCTIONS, **strings.FUNCTIONS, **arrays.FUNCTIONS, **datetimes.FUNCTIONS, **system.FUNCTIONS}


def call(name: str, *args: Column) -> Column:
    if name.lower() not in FUNCTIONS:
        raise LookupError(f"42883: function {name} does not exist")
    return FUNCTIONS[name.lower()](*args)
