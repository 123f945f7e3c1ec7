"""Session and system functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def current_setting(name: str, missing_ok: bool = False) -> Column:
    value = SparkSession.active().conf.get(name, None)
    if value is None and not missing_ok:
        raise LookupError(f"42704: unrecognized configuration parameter {name!r}")
    return F.lit(value)


_TYPE_NAMES = {
    "tinyint": "smallint", "int": "integer", "float": "real", "double": "double precision", "string": "text", "binary": "bytea",
    "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone",
}


def pg_typeof(x: Column) -> Column:
    """The type's PostgreSQL name; arrays end in ``[]``."""
    name = F.typeof(x)
    inner = F.regexp_replace(name, r"^array<(.*)>$", "$1")
    inner = F.regexp_replace(inner, r"\(.*\)$", "")
    names = F.create_map(*(F.lit(v) for pair in (_TYPE_NAMES | {"decimal": "numeric"}).items() for v in pair))
    return F.concat(F.coalesce(names[inner], inner), F.when(name.startswith("array"), "[]").otherwise(""))


FUNCTIONS = {
    "current_user": F.current_user, "session_user": F.current_user, "user": F.current_user, "current_role": F.current_user,
    "current_database": F.current_database, "current_catalog": F.current_catalog, "current_schema": lambda: F.lit("public"),
    "current_schemas": lambda *_: F.array(F.lit("public")), "version": F.version, "current_setting": current_setting,
    "pg_typeof": pg_typeof, "gen_random_uuid": lambda: F.call_function("uuid"),
}
