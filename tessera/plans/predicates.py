"""Projections, predicates, casts and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, datetimes
from ..operators import expressions as E
from ..operators import types as K
from ..sources import load
from .registry import both, query

both("filter_three_valued", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') = 'O' AND NOT (nullif(o_custkey % 7, 0) > 3)")
both("project_star_and_names", "SELECT c.*, c_acctbal * 2 AS twice, upper(c_name) AS upper_name FROM customer c")
both("comparisons", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")

_T = "(SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM customer) t"
both("and_or_not", f"SELECT k, a AND b AS a_and_b, a OR b AS a_or_b, NOT a AS not_a FROM {_T}")
both("is_null", f"SELECT k, a IS NULL AS n, b IS NOT NULL AS nn FROM {_T}")
both("is_true_false_unknown", f"SELECT k, a IS TRUE AS t, a IS NOT TRUE AS nt, a IS FALSE AS f, a IS NOT FALSE AS nf, a IS UNKNOWN AS u, a IS NOT UNKNOWN AS nu FROM {_T}", f"SELECT k, a IS NOT DISTINCT FROM true AS t, a IS DISTINCT FROM true AS nt, a IS NOT DISTINCT FROM false AS f, a IS DISTINCT FROM false AS nf, a IS NULL AS u, a IS NOT NULL AS nu FROM {_T}")
both("is_distinct_from", f"SELECT k, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM {_T}")


@query("SELECT p_partkey, ((p_size >= 30 AND p_size <= p_partkey % 40) OR (p_size >= p_partkey % 40 AND p_size <= 30)) AS inside, (p_size BETWEEN 5 AND 15) AS plain FROM part")
def between_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    return p.select("p_partkey", E.between_symmetric(p.p_size, F.lit(30), p.p_partkey % 40).alias("inside"), p.p_size.between(5, 15).alias("plain"))


both("in_list", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS i, nullif(o_orderstatus, 'P') NOT IN ('F', 'X') AS n FROM orders WHERE o_orderkey % 11 IN (1, 2, 3, 5, 8, NULL)")
both("row_in", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW'))")


@query(
    """SELECT p_partkey, p_name LIKE '%e_' AS a, p_type NOT LIKE 'S%' AS b, ('x%' || p_name) LIKE 'x!%%' ESCAPE '!' AS c,
       p_name ILIKE '%A%' AS d FROM part"""
)
def like_ilike_escape(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    escaped = E.like(F.concat(F.lit("x%"), p.p_name), "x!%%", "!")
    return p.select("p_partkey", E.like(p.p_name, "%e_").alias("a"), (~E.like(p.p_type, "S%")).alias("b"), escaped.alias("c"), E.ilike(p.p_name, "%A%").alias("d"))


@query("""SELECT p_partkey, regexp_matches(p_type, '^[A-M]+') AS a, regexp_matches(p_type, '(?i)steel|tin') AS b, NOT regexp_matches(p_brand, '[13]$') AS c FROM part""")
def regex_match(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    return p.select("p_partkey", E.matches(p.p_type, "^[A-M]+").alias("a"), E.matches(p.p_type, "steel|tin", True).alias("b"), (~E.matches(p.p_brand, "[13]$")).alias("c"))


@query(
    """SELECT k, (a < 2 OR (a = 2 AND b < 1)) AS lt, (a < 2 OR (a = 2 AND b <= 1)) AS le, (a = 2 AND b = 1) AS eq FROM
       (SELECT c_custkey AS k, nullif(c_custkey % 4, 0) AS a, nullif(c_custkey % 3, 2) AS b FROM customer) t"""
)
def row_comparison(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer").selectExpr("c_custkey AS k", "nullif(c_custkey % 4, 0) AS a", "nullif(c_custkey % 3, 2) AS b")
    left, right = [t.a, t.b], [F.lit(2), F.lit(1)]
    return t.select("k", E.row_less(left, right).alias("lt"), E.row_less(left, right, True).alias("le"), E.row_equal(left, right).alias("eq"))


both(
    "case_coalesce_nullif",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS searched,
       CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS simple, coalesce(nullif(p_size % 4, 0), nullif(p_size % 5, 0), -1) AS c FROM part""",
)
both("greatest_least_skip_nulls", "SELECT p_partkey, greatest(nullif(p_size % 4, 0), p_size % 3, 1) AS g, least(nullif(p_size % 4, 0), p_size % 3, 2) AS l FROM part")


@query(
    """SELECT k, CAST(round_even(x, 0) AS INTEGER) AS from_double, CAST(round(CAST(x AS DECIMAL(12,2)), 0) AS INTEGER) AS from_numeric,
       CAST(b AS VARCHAR) AS from_bool, CAST(CAST(x AS DECIMAL(12,1)) AS DOUBLE) AS one_place, substr(s, 1, 5) AS cut
       FROM (SELECT c_custkey AS k, c_custkey * 0.25 AS x, c_custkey % 2 = 0 AS b, c_name AS s FROM customer) t"""
)
def casts_and_rounding(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer").selectExpr("c_custkey AS k", "CAST(c_custkey AS DOUBLE) * 0.25D AS x", "c_custkey % 2 = 0 AS b", "c_name AS s")
    numeric = T.DecimalType(12, 2)
    return t.select(
        "k", K.to_integer(t.x, T.DoubleType()).alias("from_double"), K.to_integer(t.x.cast(numeric), numeric).alias("from_numeric"),
        t.b.cast("string").alias("from_bool"), t.x.cast("decimal(12,1)").cast("double").alias("one_place"), K.to_varchar(t.s, 5).alias("cut"),
    )


@query("""SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, embedding[100000] IS NULL AS outside, len([vec_id, label]) AS two FROM embeddings""")
def array_subscripts(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings")
    a = e.embedding
    return e.select("vec_id", arrays.element(a, F.lit(1)).cast("double").alias("first"), arrays.element(a, F.size(a)).cast("double").alias("last"), arrays.element(a, F.lit(100000)).isNull().alias("outside"), F.cardinality(F.array("vec_id", F.col("label").cast("bigint"))).cast("bigint").alias("two"))


@query(
    """SELECT k, CASE WHEN x IN (1, 3) THEN true WHEN x IS NULL THEN NULL ELSE NULL END AS any_eq,
       CASE WHEN x IS NULL THEN NULL WHEN x > 3 THEN true ELSE false END AS all_gt, false AS any_empty, true AS all_empty
       FROM (SELECT c_custkey AS k, nullif(c_custkey % 6, 5) AS x FROM customer) t"""
)
def any_all_array(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "customer").selectExpr("c_custkey AS k", "nullif(c_custkey % 6, 5) AS x")
    with_null, plain, empty = (F.expr(a) for a in ("array(1L, 3L, NULL)", "array(1L, 3L)", "cast(array() as array<bigint>)"))
    return t.select("k", E.any_of(t.x, with_null).alias("any_eq"), E.all_of(t.x, plain, Column.__gt__).alias("all_gt"), E.any_of(t.x, empty).alias("any_empty"), E.all_of(t.x, empty).alias("all_empty"))


@query("SELECT c_custkey, c_name || '-' || c_mktsegment AS t, nullif(c_name, c_name) || 'x' AS n, CAST(len(list_concat([c_custkey], [CAST(c_nationkey AS BIGINT)])) AS INTEGER) AS both_len, c_custkey AS one_side FROM customer")
def concatenation(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "customer")
    one, two = F.array(c.c_custkey), F.array(c.c_nationkey.cast("bigint"))
    none = F.lit(None).cast("array<bigint>")
    return c.select("c_custkey", F.concat(c.c_name, F.lit("-"), c.c_mktsegment).alias("t"), F.concat(F.nullif(c.c_name, c.c_name), F.lit("x")).alias("n"), F.size(arrays.concat(one, two)).alias("both_len"), F.get(arrays.concat(one, none), F.lit(0)).alias("one_side"))


@query(
    """SELECT p_partkey, p_size + 3 AS a, p_size - 50 AS s, p_size * 7 AS m, (p_size - 25) // 7 AS d, (p_size - 25) % 7 AS r, -p_size AS neg,
       CAST(pow(p_size, 3) AS DOUBLE) AS cube, p_size & 12 AS band, p_size | 12 AS bor, xor(p_size, 12) AS bxor, p_size << 2 AS shl, p_size >> 2 AS shr FROM part"""
)
def arithmetic_and_bits(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    x = p.p_size
    return p.select(
        "p_partkey", (x + 3).alias("a"), (x - 50).alias("s"), (x * 7).alias("m"), E.int_div(x - 25, F.lit(7)).cast("int").alias("d"), ((x - 25) % 7).alias("r"), (-x).alias("neg"),
        E.power(x, F.lit(3)).alias("cube"), x.bitwiseAND(12).alias("band"), x.bitwiseOR(12).alias("bor"), E.bit_xor(x, F.lit(12)).alias("bxor"), F.shiftleft(x, 2).alias("shl"), F.shiftright(x, 2).alias("shr"),
    )


@query("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) / 7, 6) AS DOUBLE) AS q FROM part")
def numeric_division(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "part")
    quotient = E.numeric_div(p.p_retailprice.cast("decimal(12,2)"), F.lit(7))
    return p.select("p_partkey", F.round(quotient, 6).cast("double").alias("q"))


@query(
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS earlier,
       CAST(CAST(o_orderdate AS DATE) - DATE '1996-02-29' AS INTEGER) AS days, o_orderdate + INTERVAL 1 MONTH AS month_on,
       o_orderdate - INTERVAL 36 HOUR AS hours_back FROM orders"""
)
def date_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    day = o.o_orderdate.cast("date")
    return o.select(
        "o_orderkey", F.date_add(day, 30).alias("later"), F.date_sub(day, 7).alias("earlier"), datetimes.days_between(day, F.lit("1996-02-29").cast("date")).alias("days"),
        (o.o_orderdate + F.expr("INTERVAL 1 MONTH")).alias("month_on"), (o.o_orderdate - F.expr("INTERVAL 36 HOUR")).alias("hours_back"),
    )


both("collate_is_bytewise", "SELECT DISTINCT p_brand FROM part WHERE p_brand COLLATE UTF8_BINARY > 'Brand#3'", "SELECT DISTINCT p_brand FROM part WHERE p_brand > 'Brand#3'")


@query("SELECT event_id, ts - INTERVAL 5 HOUR AS new_york_winter FROM events WHERE month(ts) IN (1, 2, 12)")
def at_time_zone(spark: SparkSession, folder: str) -> DataFrame:
    """A moment in UTC as the local time of another zone."""
    e = load(spark, folder, "events").filter("month(ts) IN (1, 2, 12)")
    return e.select("event_id", datetimes.timezone_of_moment(F.lit("America/New_York"), F.col("ts")).alias("new_york_winter"))


both("parameters", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 5000", nation=7, least=5000)
