"""EXPLAIN, SET, SHOW and prepared statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.utility import explain, prepare, reset, set_, show
from ..sources import register_views
from .registry import query


@query("SELECT true AS scan, true AS pushed, true AS topn")
def explain_plan(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, folder, "orders")
    text = explain(spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 5"))
    found = "Scan parquet" in text, "GreaterThan(o_totalprice" in text, "TakeOrderedAndProject" in text
    return spark.createDataFrame([found], "scan boolean, pushed boolean, topn boolean")


@query("SELECT 'off' AS set_to, 'on' AS after_reset")
def set_show_reset(spark: SparkSession, folder: str) -> DataFrame:
    set_(spark, "enable_hashjoin", "off")
    first = show(spark, "enable_hashjoin")
    reset(spark, "enable_hashjoin")
    return spark.createDataFrame([(first, show(spark, "enable_hashjoin"))], "set_to string, after_reset string")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 10")
def prepared_statement(spark: SparkSession, folder: str) -> DataFrame:
    register_views(spark, folder, "nation")
    return prepare(spark, "SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2")(2, 10)
