"""EXPLAIN, settings and prepared statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Planner switches by the Spark settings that stand for them: (name, value for on, value for off).
SWITCHES = {
    "enable_hashjoin": ("spark.sql.join.preferSortMergeJoin", "false", "true"),
    "enable_broadcast": ("spark.sql.autoBroadcastJoinThreshold", "10485760", "-1"),
    "enable_adaptive": ("spark.sql.adaptive.enabled", "true", "false"),
    "enable_cbo": ("spark.sql.cbo.enabled", "true", "false"),
    "enable_mergejoin": ("spark.sql.join.preferSortMergeJoin", "true", "false"),
    "enable_nestloop": ("spark.sql.crossJoin.enabled", "true", "false"),
    "enable_indexscan": ("spark.sql.parquet.filterPushdown", "true", "false"),
    "enable_seqscan": ("tessera.enable_seqscan", "true", "false"),  # every scan is one: kept and shown only
}
_NAMES = {"timezone": "spark.sql.session.timeZone", "work_partitions": "spark.sql.shuffle.partitions"}
_shown: dict[str, str] = {}


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def set_(spark: SparkSession, name: str, value: str) -> None:
    """SET name = value; the session time zone must be UTC."""
    if name.lower() in ("timezone", "time zone") and value.upper() != "UTC":
        raise ValueError("22023: only UTC is supported as the session time zone")
    if name in SWITCHES:
        key, on, off = SWITCHES[name]
        spark.conf.set(key, on if value.lower() in ("on", "true", "1") else off)
        _shown[name] = "on" if value.lower() in ("on", "true", "1") else "off"
    else:
        spark.conf.set(_NAMES.get(name.lower(), name), value)


def show(spark: SparkSession, name: str) -> str:
    if name in SWITCHES:
        return _shown.get(name, "on")
    value = spark.conf.get(_NAMES.get(name.lower(), name), None)
    if value is None:
        raise LookupError(f"42704: unrecognized configuration parameter {name!r}")
    return value


def reset(spark: SparkSession, name: str) -> None:
    spark.conf.unset(SWITCHES[name][0] if name in SWITCHES else _NAMES.get(name.lower(), name))
    _shown.pop(name, None)


def prepare(spark: SparkSession, sql: str) -> Callable[..., DataFrame]:
    """A statement with parameters $1, $2, ...; call it with their values."""
    from ..dialect import run_tokens, statement

    tokens = statement(sql)
    return lambda *values: run_tokens(spark, tokens, *values)
