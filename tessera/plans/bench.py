"""The analytical queries that throughput is measured by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.subqueries import in_as_value
from ..sources import load
from .registry import both, query

# Cents and hundredths as whole numbers: sums are exact and stay in long arithmetic.
_PRICE = "CAST(l_extendedprice * 100 + 0.5 AS BIGINT)"
_LEFT = "(100 - CAST(l_discount * 100 + 0.5 AS BIGINT))"
_REVENUE = f"CAST(sum({_PRICE} * {_LEFT}) AS DOUBLE) / 10000"


def _twin(sql: str) -> str:
    """The other engine rounds where Spark's cast cuts."""
    return sql.replace("* 100 + 0.5 AS BIGINT", "* 100 AS BIGINT")


_Q1 = f"SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, {_REVENUE} AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01 00:00:00' GROUP BY l_returnflag ORDER BY l_returnflag"
both("q1", _Q1, _twin(_Q1))
_Q2 = """SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(o_totalprice * 100 + 0.5 AS BIGINT)) AS DOUBLE) / 100 AS total FROM customer JOIN orders ON o_custkey = c_custkey
         WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY c_nationkey ORDER BY total DESC"""
both("q2", _Q2, _twin(_Q2))
_Q3 = f"""SELECT o_orderkey, o_orderdate, {_REVENUE} AS rev FROM customer
        JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY o_orderkey, o_orderdate ORDER BY rev DESC, o_orderkey LIMIT 10"""
both("flagship", _Q3, _twin(_Q3))
both("q4", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderstatus ORDER BY o_orderstatus")
both("q5", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
both("q6", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
both("q7", "SELECT o_totalprice, o_orderdate FROM orders WHERE o_orderkey = 4321")
both("q8", "SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_custkey < 0")
def q9(spark: SparkSession, folder: str) -> DataFrame:
    """The test of q8 as a value under OR."""
    big = load(spark, folder, "orders").filter("o_totalprice > 400000").select("o_custkey")
    rows = in_as_value(load(spark, folder, "customer"), "c_custkey", big, "o_custkey", "has")
    return rows.filter("has OR c_custkey < 0").agg(F.count("*").alias("n"))
