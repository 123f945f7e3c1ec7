"""Scans, constant rows, series, derived tables and COPY."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dialect
from ..operators import relational as R
from ..scratch import scratch_path
from ..sources import TABLES, copy_from, copy_to, load
from ..sources.parquet import clustered
from .registry import both, query

both("seq_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77 AND o_orderkey BETWEEN 100 AND 12000")
def index_scan(spark: SparkSession, folder: str) -> DataFrame:
    """An equality prefix and a range, on data clustered by both columns."""
    path = scratch_path(spark, "clustered")
    clustered(load(spark, folder, "orders"), path, "o_custkey", "o_orderkey", files=4)
    return spark.read.parquet(path).filter("o_custkey = 77 AND o_orderkey BETWEEN 100 AND 12000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = NULL")
def index_scan_null_bound(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").filter(F.col("o_custkey") == F.lit(None)).select("o_orderkey")


both("index_ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")


@query(f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name IN {TABLES}")
def information_schema_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A system table made on demand from the schemas of all tables."""
    rows = [(t, c, i + 1) for t in TABLES for i, c in enumerate(load(spark, folder, t).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) t(column1, column2)")
def values_rows(spark: SparkSession, folder: str) -> DataFrame:
    return R.values(spark, [(1, "a"), (2, None), (None, "c")], "column1 int, column2 string")


both("select_without_from", "SELECT 1 + 1 AS two, 'x' AS x, CAST(NULL AS INT) AS nothing")
both("table_statement", "TABLE region", "SELECT * FROM region")


@query("SELECT generate_series AS g FROM generate_series(CAST(3 AS BIGINT), CAST(30 AS BIGINT), CAST(4 AS BIGINT))")
def generate_series_up(spark: SparkSession, folder: str) -> DataFrame:
    return R.generate_series(spark, 3, 30, 4, "g")


@query("SELECT generate_series AS g FROM generate_series(CAST(10 AS BIGINT), CAST(-10 AS BIGINT), CAST(-5 AS BIGINT))")
def generate_series_down(spark: SparkSession, folder: str) -> DataFrame:
    return R.generate_series(spark, 10, -10, -5, "g")


@query("SELECT CAST(1 AS BIGINT) AS g WHERE false")
def generate_series_empty(spark: SparkSession, folder: str) -> DataFrame:
    return R.generate_series(spark, 1, 0, 1, "g")


@query(
    """SELECT n_nationkey, CAST(1.0 + 0.5 * i AS DOUBLE) AS x FROM nation, (SELECT generate_series AS i FROM generate_series(0, 4)) s
       WHERE 1.0 + 0.5 * i <= 1.0 + n_regionkey * 0.5"""
)
def generate_series_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """A series of numeric, each row with its own end."""
    n = load(spark, folder, "nation")
    one, half = F.lit(1.0).cast("decimal(6,2)"), F.lit(0.5).cast("decimal(6,2)")
    stop = (one + n.n_regionkey.cast("decimal(4,0)") * half).cast("decimal(6,2)")
    steps = F.floor((stop - one) / half).cast("int")
    series = F.transform(F.sequence(F.lit(0), steps), lambda i: (one + i.cast("decimal(4,0)") * half).cast("double"))
    return n.select("n_nationkey", F.explode(series).alias("x"))


@query("SELECT CAST(generate_series AS TIMESTAMP) AS ts FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 00:00:00', INTERVAL 5 HOUR)")
def generate_series_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return dialect.run(spark, "SELECT ts FROM generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-02 00:00:00', interval '5 hours') AS s(ts)")


@query("SELECT vec_id, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) t")
def unnest_array(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    return R.unnest(rows, "embedding", "e").select("vec_id", F.col("e").cast("double").alias("e"))


both("derived_table", "SELECT k, n FROM (SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey) AS t(k, n) WHERE n > 40")
both(
    "cte",
    """WITH big(k, price) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000),
            n AS (SELECT count(*) AS c FROM big)
       SELECT b.k, b.price, n.c FROM big b CROSS JOIN n WHERE b.price > 350000""",
)

_TEXT = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.TimestampNTZType())])
_TEXT_SQL = """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ''
    WHEN c_custkey % 5 = 2 THEN c_name || '{}' ELSE c_mktsegment END AS a, c_acctbal AS d,
    CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-02-03 04:05:06' END AS t FROM customer"""


def _awkward(spark: SparkSession, folder: str, extra: str) -> DataFrame:
    c = load(spark, folder, "customer")
    m = F.col("c_custkey") % 5
    text = F.when(m == 1, "").when(m == 2, F.concat("c_name", F.lit(extra))).when(m > 2, F.col("c_mktsegment"))
    stamp = F.when(F.col("c_custkey") % 3 > 0, F.lit("2024-02-03 04:05:06").cast("timestamp_ntz"))
    return c.select(F.col("c_custkey").alias("k"), text.alias("a"), F.col("c_acctbal").alias("d"), stamp.alias("t"))


@query(_TEXT_SQL.replace("'{}'", "chr(9) || '|' || chr(92) || 'N' || chr(10) || '|'"))
def copy_text(spark: SparkSession, folder: str) -> DataFrame:
    """COPY TO and FROM in the text form, with tabs, newlines, backslashes, empty strings and nulls."""
    path = scratch_path(spark, "copy-text")
    copy_to(_awkward(spark, folder, "\t|\\N\n|"), path)
    return copy_from(spark, path, _TEXT)


@query(_TEXT_SQL.replace("'{}'", "',' || chr(34) || ' x'"))
def copy_csv(spark: SparkSession, folder: str) -> DataFrame:
    """COPY TO and FROM in the CSV form, with delimiters, quotes, empty strings and nulls."""
    path = scratch_path(spark, "copy-csv")
    copy_to(_awkward(spark, folder, '," x'), path, "csv", header=True)
    return copy_from(spark, path, _TEXT, "csv", header=True)
