"""Joins of every kind and strategy, and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import subqueries as S
from ..sources import load
from .registry import both, query

_OC = "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 WHERE o_orderstatus = 'F'"


def _orders_customers(strategy: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        o, c = load(spark, folder, "orders").filter("o_orderstatus = 'F'"), load(spark, folder, "customer")
        on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 20)
        return R.join(o, c, on, strategy=strategy).select("o_orderkey", "c_name", "o_totalprice")

    return run


for _name, _strategy in (("hash_join", "hash"), ("merge_join", "merge"), ("lookup_join_broadcast", "broadcast")):
    query(_OC, _name)(_orders_customers(_strategy))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def nested_loop_join(spark: SparkSession, folder: str) -> DataFrame:
    n = load(spark, folder, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))
    return R.join(a, b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


_L = "(SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS r FROM nation) l"
_R = "(SELECT r_regionkey AS rk, r_name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT NULL, 'none' UNION ALL SELECT 9, 'nine') g"
for _kind in ("LEFT", "RIGHT", "FULL"):
    both(f"{_kind.lower()}_join_null_keys", f"SELECT k, r, rk, r_name FROM {_L} {_kind} JOIN {_R} ON r = rk AND k < 20")
both("full_join_theta", f"SELECT k, rk FROM {_L} FULL JOIN {_R} ON r > rk")
both("semi_join_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
both("anti_join_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 4")
both("comma_join", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey AND r_regionkey > 1")
both("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer WHERE c_acctbal > 9000) y USING (k)")


@query("SELECT coalesce(x.k, y.k) AS k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 10) x FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_nationkey > 5 GROUP BY s_nationkey) y ON x.k = y.k")
def full_join_using(spark: SparkSession, folder: str) -> DataFrame:
    x = load(spark, folder, "nation").filter("n_nationkey < 10").selectExpr("n_nationkey AS k", "n_name AS a")
    y = load(spark, folder, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b"))
    return x.join(y, ["k"], "full")


@query("SELECT x.k, x.g, a, b FROM (SELECT n_nationkey AS k, n_regionkey AS g, n_name AS a FROM nation) x JOIN (SELECT n_nationkey AS k, n_regionkey AS g, upper(n_name) AS b FROM nation WHERE n_regionkey > 1) y ON x.k = y.k AND x.g = y.g")
def natural_join(spark: SparkSession, folder: str) -> DataFrame:
    n = load(spark, folder, "nation")
    return R.natural_join(n.selectExpr("n_nationkey AS k", "n_regionkey AS g", "n_name AS a"), n.filter("n_regionkey > 1").selectExpr("n_nationkey AS k", "n_regionkey AS g", "upper(n_name) AS b"))


@query(
    """SELECT p_partkey, band FROM part JOIN (SELECT n_nationkey AS band, n_nationkey * 2 AS lo, n_nationkey * 2 + 1 + n_nationkey % 4 AS hi FROM nation) s
       ON p_size >= lo AND p_size < hi"""
)
def interval_join(spark: SparkSession, folder: str) -> DataFrame:
    spans = load(spark, folder, "nation").selectExpr("n_nationkey AS band", "n_nationkey * 2 AS lo", "n_nationkey * 2 + 1 + n_nationkey % 4 AS hi")
    return R.interval_join(load(spark, folder, "part"), spans, "p_size", "lo", "hi", 8).select("p_partkey", "band")


both(
    "three_way_join",
    "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name",
)

# subqueries
both("scalar_uncorrelated", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) - 10 FROM supplier)")
both("scalar_no_rows_is_null", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS nothing FROM nation")
both("scalar_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
both("scalar_correlated_min", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS k FROM customer")
both("exists_in_select", "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000) AS e FROM nation", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) AS e FROM nation")
both("exists_under_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)", "SELECT c_custkey FROM customer WHERE c_acctbal > 9900 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
both("exists_with_limit", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey LIMIT 1)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
both("in_correlated", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = o_custkey % 100 AND l_quantity > 40)", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 100 AND l_quantity > 40)")
both("in_uncorrelated", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
both("not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
both("not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)")
both("in_over_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("having_exists", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) GROUP BY c_nationkey")


@query(
    """SELECT k, CASE WHEN x IS NULL THEN NULL WHEN x IN (1, 3) THEN true ELSE NULL END AS open, CASE WHEN x IS NULL THEN NULL ELSE x IN (1, 3) END AS closed,
       CASE WHEN x IS NULL THEN NULL WHEN x IN (1, 3) THEN false ELSE NULL END AS not_open FROM
       (SELECT n_nationkey AS k, nullif(n_nationkey % 6, 5) AS x FROM nation) t"""
)
def in_as_value(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "nation").selectExpr("n_nationkey AS k", "nullif(n_nationkey % 6, 5) AS x")
    plain = load(spark, folder, "region").filter("r_regionkey IN (1, 3)").selectExpr("r_regionkey AS y")
    with_null = load(spark, folder, "region").filter("r_regionkey IN (1, 3, 4)").selectExpr("nullif(r_regionkey, 4) AS y")
    rows = S.in_as_value(t, "x", with_null, "y", "open")
    rows = S.in_as_value(rows, "x", plain, "y", "closed")
    return S.in_as_value(rows, "x", with_null, "y", "not_open", negated=True).select("k", "open", "closed", "not_open")


@query(
    """SELECT c_custkey, c_acctbal > (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 3) AS gt_all, c_acctbal < (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 3) AS lt_any,
       true AS all_of_none, false AS any_of_none, CASE WHEN c_acctbal <= (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = 3) THEN false END AS gt_all_null FROM customer"""
)
def any_all_subquery(spark: SparkSession, folder: str) -> DataFrame:
    c, s = load(spark, folder, "customer"), load(spark, folder, "supplier")
    three, none = s.filter("s_nationkey = 3").selectExpr("s_acctbal AS y"), s.filter("s_nationkey = 99").selectExpr("s_acctbal AS y")
    with_null = three.unionAll(three.limit(1).selectExpr("CAST(NULL AS DOUBLE) AS y"))
    x = F.col("c_acctbal")
    rows = S.compare_all(c, x, ">", three, "y", "gt_all")
    rows = S.compare_any(rows, x, "<", three, "y", "lt_any")
    rows = S.compare_all(rows, x, ">", none, "y", "all_of_none")
    rows = S.compare_any(rows, x, "<", none, "y", "any_of_none")
    rows = S.compare_all(rows, x, ">", with_null, "y", "gt_all_null")
    return rows.select("c_custkey", "gt_all", "lt_any", "all_of_none", "any_of_none", "gt_all_null")


@query("SELECT r_name, array_to_string(list(n_name ORDER BY n_name), ',') AS names, CAST(count(n_name) AS INTEGER) AS n FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) t ON n_regionkey = r_regionkey GROUP BY r_name")
def array_subquery(spark: SparkSession, folder: str) -> DataFrame:
    r, n = load(spark, folder, "region"), load(spark, folder, "nation").filter("n_regionkey < 4")
    rows = S.array_subquery(r, n, ("r_regionkey", "n_regionkey"), "n_name", "n_name", "a")
    return rows.select("r_name", F.when(F.size("a") > 0, F.array_join("a", ",")).alias("names"), F.size("a").alias("n"))
