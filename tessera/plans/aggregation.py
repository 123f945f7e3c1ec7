"""Aggregation, sorting, limits, distinct rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import relational as R
from ..sources import load
from .registry import both, query

_CENTS = "CAST(l_extendedprice AS DECIMAL(18,2))"

both("hash_aggregate", f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_CENTS}) AS DOUBLE) AS total, min(l_shipdate) AS first, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("aggregate_no_rows", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
both("aggregate_no_groups", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
both("group_by_ordinal_and_alias", "SELECT year(o_orderdate) AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, s")
both("group_by_null_key", "SELECT nullif(n_regionkey, 3) AS g, count(*) AS n FROM nation GROUP BY nullif(n_regionkey, 3)")
both("having", f"SELECT l_suppkey, CAST(sum({_CENTS}) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey HAVING sum({_CENTS}) > 15000000 AND count(*) > 10")
both("aggregate_in_order_by", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 20")
both("distinct_aggregates", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
both("count_distinct_pairs", "SELECT count(DISTINCT o_orderstatus, nullif(o_custkey % 50, 7)) AS n FROM orders", "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey % 50 AS m FROM orders WHERE o_custkey % 50 <> 7) t")
both("aggregate_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_orderstatus")


@query("SELECT c_nationkey, string_agg(c_name, '; ' ORDER BY c_acctbal, c_custkey) AS names, count(nullif(c_custkey % 2, 0)) AS odd FROM customer GROUP BY c_nationkey")
def string_agg_ordered(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "customer")
    return c.groupBy("c_nationkey").agg(A.string_agg(c.c_name, "; ", c.c_acctbal, c.c_custkey).alias("names"), F.count(F.expr("nullif(c_custkey % 2, 0)")).alias("odd"))


@query("SELECT n_regionkey, array_to_string(list(coalesce(CAST(nullif(n_nationkey % 4, 1) AS VARCHAR), 'null') ORDER BY n_nationkey), ',') AS a, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
def array_agg_keeps_nulls(spark: SparkSession, folder: str) -> DataFrame:
    n = load(spark, folder, "nation")
    a = A.array_agg(F.expr("nullif(n_nationkey % 4, 1)"), n.n_nationkey)
    rows = n.groupBy("n_regionkey").agg(a.alias("x"))
    return rows.select("n_regionkey", F.array_join(F.col("x").cast("array<string>"), ",", "null").alias("a"), F.size("x").alias("n"))


@query("SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) * 1000000000000) AS VARCHAR) AS s, CAST(sum(o_custkey) AS BIGINT) AS small FROM orders")
def sum_exact(spark: SparkSession, folder: str) -> DataFrame:
    """A sum beyond 64 bits."""
    o = load(spark, folder, "orders")
    return o.agg(A.sum_exact(F.col("o_orderkey").cast("decimal(20,0)") * F.lit(1000000000000).cast("decimal(13,0)")).cast("string").alias("s"), A.sum_exact(o.o_custkey).cast("bigint").alias("small"))


@query("SELECT c_nationkey, round(avg(c_custkey), 6) AS ids, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS balance FROM customer GROUP BY c_nationkey")
def avg_exact(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "customer")
    return c.groupBy("c_nationkey").agg(F.round(A.avg_exact(c.c_custkey, kind="decimal(20,0)").cast("double"), 6).alias("ids"), F.round(A.avg_exact(c.c_acctbal, kind="decimal(18,2)").cast("double"), 4).alias("balance"))


both("min_max_text", "SELECT p_size, min(p_name) AS lo, max(p_type) AS hi FROM part GROUP BY p_size")
both("bool_aggregates", "SELECT c_nationkey, bool_and(c_acctbal > -990) AS a, bool_or(c_acctbal > 9990) AS o, every(c_custkey > 0) AS e FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, bool_and(c_acctbal > -990) AS a, bool_or(c_acctbal > 9990) AS o, bool_and(c_custkey > 0) AS e FROM customer GROUP BY c_nationkey")
both("variance_family", "SELECT p_size, round(variance(p_retailprice), 4) AS v, round(var_samp(p_retailprice), 4) AS vs, round(var_pop(p_retailprice), 4) AS vp, round(stddev(p_retailprice), 4) AS s, round(stddev_samp(p_retailprice), 4) AS ss, round(stddev_pop(p_retailprice), 4) AS sp FROM part GROUP BY p_size")
both("variance_of_one_row", "SELECT n_nationkey, var_samp(n_regionkey) AS v, stddev_pop(n_regionkey) AS p FROM nation GROUP BY n_nationkey")
both("shared_aggregates", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_linenumber) + count(*) AS BIGINT) AS t FROM lineitem GROUP BY l_returnflag")

both("sort_null_placement", "SELECT k FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS r FROM nation) t ORDER BY r ASC NULLS LAST, k LIMIT 22")


@query("SELECT n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation) t ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 7")
def sort_desc_nulls_first(spark: SparkSession, folder: str) -> DataFrame:
    n = load(spark, folder, "nation").selectExpr("n_nationkey", "nullif(n_regionkey, 1) AS r")
    return R.limit_offset(R.order_by(n, "-r", "n_nationkey"), 7).select("n_nationkey")


both("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 40")
def limit_and_offset(spark: SparkSession, folder: str) -> DataFrame:
    return R.limit_offset(R.order_by(load(spark, folder, "orders"), "o_orderkey"), 30, 40).select("o_orderkey")


@query("SELECT n_nationkey FROM nation")
def limit_null_is_all(spark: SparkSession, folder: str) -> DataFrame:
    return R.limit_offset(load(spark, folder, "nation"), None).select("n_nationkey")


both("distinct", "SELECT DISTINCT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) t WHERE i = 1")
def distinct_on(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    return R.distinct_on(o, ["o_custkey"], o.o_totalprice.desc_nulls_first(), o.o_orderkey.asc_nulls_last()).select("o_custkey", "o_orderkey", "o_totalprice")


_A = "SELECT nullif(o_custkey % 20, 3) AS x, o_orderstatus AS s FROM orders"
_B = "SELECT nullif(c_nationkey, 3) AS y, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS t FROM customer"


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a = load(spark, folder, "orders").selectExpr("nullif(o_custkey % 20, 3) AS x", "o_orderstatus AS s")
    b = load(spark, folder, "customer").selectExpr("nullif(c_nationkey, 3) AS y", "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS t")
    return a, b


for _name, _word, _f in (
    ("union_all", "UNION ALL", R.union_all), ("union", "UNION", R.union), ("intersect", "INTERSECT", R.intersect),
    ("intersect_all", "INTERSECT ALL", R.intersect_all), ("except", "EXCEPT", R.except_), ("except_all", "EXCEPT ALL", R.except_all),
):
    query(f"{_A} {_word} {_B.replace('AS y', 'AS x')}", f"set_{_name}")(lambda spark, folder, f=_f: f(*_sides(spark, folder)))


@query("SELECT x FROM (SELECT n_regionkey AS x FROM nation WHERE n_nationkey < 5 UNION ALL (SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_nationkey > 20)) t ORDER BY x LIMIT 6")
def set_precedence_and_limit(spark: SparkSession, folder: str) -> DataFrame:
    n, r = load(spark, folder, "nation"), load(spark, folder, "region")
    inner = R.intersect(r.selectExpr("r_regionkey AS x"), n.filter("n_nationkey > 20").selectExpr("n_regionkey"))
    return R.limit_offset(R.order_by(R.union_all(n.filter("n_nationkey < 5").selectExpr("n_regionkey AS x"), inner), "x"), 6)
