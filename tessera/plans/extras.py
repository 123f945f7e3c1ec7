"""Operators beyond parity: windows, rollups and streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dialect import run
from ..scratch import scratch_path
from ..sources import load, register_views
from ..streaming import windowed_counts
from .registry import both, query

both("extra_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def extra_running_count(spark: SparkSession, folder: str) -> DataFrame:
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, folder, "events").select("event_id", "user_id", F.count("*").over(so_far).alias("n"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extra_streaming_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by a stream over the table's file, run until it has read all."""
    return windowed_counts(spark, f"{folder}/events.parquet", "1 hour", scratch_path(spark, "stream"))


_PG = """SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey AS k, o_totalprice::numeric(12,2)::float8 AS p, 7 / 2 AS q, o_orderpriority ~ '^[12]' AS urgent
    FROM orders WHERE o_custkey BETWEEN SYMMETRIC 300 AND 10 AND o_orderstatus = ANY (ARRAY['F', 'O']) ORDER BY o_custkey, o_totalprice DESC, o_orderkey"""


@query(
    """SELECT c, k, p, 3 AS q, urgent FROM (SELECT o_custkey AS c, o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS p, regexp_matches(o_orderpriority, '^[12]') AS urgent,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders WHERE o_custkey BETWEEN 10 AND 300 AND o_orderstatus IN ('F', 'O')) t WHERE i = 1"""
)
def postgres_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """A statement in PostgreSQL's own words."""
    register_views(spark, folder, "orders")
    return run(spark, _PG)
