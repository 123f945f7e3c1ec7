"""Scalar functions over table columns, group by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import call, datetimes, maths, strings, system
from ..operators import types as K
from ..sources import load
from .registry import query

_X = "(SELECT p_partkey AS k, (p_partkey % 41 - 20) * 0.375 AS x, CAST((p_partkey % 41 - 20) * 0.375 AS DECIMAL(12,3)) AS n, p_size AS i FROM part) t"


def _x(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 41 - 20 AS DOUBLE) * 0.375D AS x", "CAST((p_partkey % 41 - 20) * 0.375 AS DECIMAL(12,3)) AS n", "p_size AS i")


@query(
    f"""SELECT k, abs(x) AS a, CAST(abs(n) AS DOUBLE) AS an, CAST(ceil(x) AS DOUBLE) AS c, CAST(floor(x) AS DOUBLE) AS f, CAST(sign(x) AS DOUBLE) AS s,
        round_even(x, 0) AS r, CAST(round(n, 1) AS DOUBLE) AS rn, CAST(round(n * 100, -2) AS DOUBLE) AS rneg, CAST(trunc(x) AS DOUBLE) AS t,
        CAST(sign(n) * floor(abs(n) * 10) / 10 AS DOUBLE) AS tn, i % 7 AS m, CAST(trunc(x / 0.5) AS DOUBLE) AS d FROM {_X}"""
)
def math_rounding(spark: SparkSession, folder: str) -> DataFrame:
    t = _x(spark, folder)
    return t.select(
        "k", call("abs", t.x).alias("a"), call("abs", t.n).cast("double").alias("an"), call("ceil", t.x).alias("c"), call("floor", t.x).alias("f"), call("sign", t.x).alias("s"),
        maths.round_double(t.x).alias("r"), maths.round_numeric(t.n, 1).cast("double").alias("rn"), maths.round_numeric(t.n * 100, -2).cast("double").alias("rneg"),
        maths.trunc_double(t.x).alias("t"), maths.trunc(t.n, 1).cast("double").alias("tn"), call("mod", t.i, F.lit(7)).alias("m"),
        maths.div(t.n, F.lit(0.5).cast("decimal(2,1)")).cast("double").alias("d"),
    )


@query(
    f"""SELECT k, round(sqrt(abs(x)), 9) AS q, round(exp(x), 9) AS e, round(ln(abs(x) + 1), 9) AS l, round(log10(abs(x) + 1), 9) AS l10,
        round(ln(abs(x) + 1) / ln(2), 9) AS l2, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(tan(x), 6) AS t, round(atan(x), 9) AS a,
        round(asin(x / 10), 9) AS si, round(acos(x / 10), 9) AS ci, round(cbrt(x), 9) AS cb, round(degrees(x), 8) AS d, round(radians(x), 9) AS r,
        round(pow(x, 3), 6) AS p, round(pi(), 9) AS pi FROM {_X}"""
)
def math_transcendental(spark: SparkSession, folder: str) -> DataFrame:
    t = _x(spark, folder)
    one = F.abs(t.x) + 1
    out = {
        "q": call("sqrt", F.abs(t.x)), "e": call("exp", t.x), "l": call("ln", one), "l10": call("log", one), "l2": call("log", F.lit(2.0), one), "s": call("sin", t.x), "c": call("cos", t.x),
        "a": call("atan", t.x), "si": call("asin", t.x / 10), "ci": call("acos", t.x / 10), "cb": call("cbrt", t.x), "r": call("radians", t.x), "pi": call("pi"),
    }
    return t.select(
        "k", *(F.round(v, 9).alias(k) for k, v in out.items()), F.round(call("tan", t.x), 6).alias("t"), F.round(call("degrees", t.x), 8).alias("d"), F.round(call("power", t.x, F.lit(3)), 6).alias("p")
    )


@query(f"SELECT k, CAST(CASE WHEN x < -5 THEN 0 WHEN x >= 5 THEN 11 ELSE floor((x + 5) / 1.0) + 1 END AS INTEGER) AS b, true AS r FROM {_X}")
def math_width_bucket_random(spark: SparkSession, folder: str) -> DataFrame:
    t = _x(spark, folder)
    r = F.rand(5)
    return t.select("k", call("width_bucket", t.x, F.lit(-5), F.lit(5), F.lit(10)).alias("b"), ((r >= 0) & (r < 1)).alias("r"))


_S = "(SELECT c_custkey AS k, c_name AS s, lower(c_mktsegment) AS g, CAST(c_custkey % 9 - 4 AS INTEGER) AS i FROM customer) t"


def _s(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").selectExpr("c_custkey AS k", "c_name AS s", "lower(c_mktsegment) AS g", "CAST(c_custkey % 9 - 4 AS INT) AS i")


@query(
    f"""SELECT k, CAST(length(s) AS INTEGER) AS n, CAST(strlen('é' || s) AS INTEGER) AS bytes, upper(g) AS u, lower(s) AS l, reverse(s) AS rev,
        upper(substr(g, 1, 1)) || substr(g, 2) || '-X1y' AS cap, replace(s, '0', 'o') AS rep, s AS rep0, translate(s, '0C#', 'ox') AS tr,
        CAST(strpos(s, '#') AS INTEGER) AS p, starts_with(s, 'Cust') AS st, md5(s) AS m, CAST(ascii(s) AS INTEGER) AS a FROM {_S}"""
)
def string_basics(spark: SparkSession, folder: str) -> DataFrame:
    t = _s(spark, folder)
    out = {
        "n": call("length", t.s), "bytes": call("octet_length", F.concat(F.lit("é"), t.s)), "u": call("upper", t.g), "l": call("lower", t.s), "rev": call("reverse", t.s),
        "cap": call("initcap", F.concat(t.g, F.lit("-x1Y"))), "rep": call("replace", t.s, F.lit("0"), F.lit("o")), "rep0": call("replace", t.s, F.lit(""), F.lit("o")),
        "tr": call("translate", t.s, F.lit("0C#"), F.lit("ox")), "p": call("strpos", t.s, F.lit("#")), "st": call("starts_with", t.s, F.lit("Cust")), "m": call("md5", t.s), "a": call("ascii", t.s),
    }
    return t.select("k", *(v.alias(n) for n, v in out.items()))


@query(
    f"""SELECT k, substr(s, 3) AS from3, substr(s, 1, CAST(greatest(i + 4, 0) AS INTEGER)) AS low, substr(s, 2, 4) AS mid, trim('  ' || g || ' ') AS bt,
        ltrim('xx' || g, 'x') AS lt, rtrim(g || '--', '-') AS rt, CASE WHEN i >= 0 THEN substr(s, 1, i) ELSE substr(s, 1, length(s) + i) END AS le,
        CASE WHEN i > 0 THEN substr(s, length(s) - i + 1) WHEN i = 0 THEN '' ELSE substr(s, 1 - i) END AS ri,
        lpad(g, 12, '*') AS lp, rpad(g, 4, '.') AS rp, repeat('ab', greatest(i, 0)) AS re FROM {_S}"""
)
def string_pieces(spark: SparkSession, folder: str) -> DataFrame:
    t = _s(spark, folder)
    out = {
        "from3": call("substr", t.s, F.lit(3)), "low": call("substr", t.s, F.lit(-2), F.greatest(t.i + 7, F.lit(0))), "mid": call("substring", t.s, F.lit(2), F.lit(4)),
        "bt": call("btrim", F.concat(F.lit("  "), t.g, F.lit(" "))), "lt": call("ltrim", F.concat(F.lit("xx"), t.g), F.lit("x")), "rt": call("rtrim", F.concat(t.g, F.lit("--")), F.lit("-")),
        "le": call("left", t.s, t.i), "ri": call("right", t.s, t.i), "lp": call("lpad", t.g, F.lit(12), F.lit("*")), "rp": call("rpad", t.g, F.lit(4), F.lit(".")), "re": call("repeat", F.lit("ab"), t.i),
    }
    return t.select("k", *(v.alias(n) for n, v in out.items()))


@query(
    f"""SELECT k, s || CASE WHEN i > 0 THEN CAST(i AS VARCHAR) ELSE '' END AS c, CASE WHEN i > 0 THEN s || '/' || CAST(i AS VARCHAR) || '/' || g ELSE s || '/' || g END AS cw,
        split_part(s, '0', 2) AS sp, chr(CAST(960 + abs(i) AS INTEGER)) AS ch, CASE WHEN i > 0 THEN printf('%x', i) ELSE 'n' END AS hx, '"' || s || '"' AS qi, g AS qi2,
        '''' || replace(g || '''s', '''', '''''') || '''' AS ql, regexp_replace(s, '0', 'X') AS r1, regexp_replace(s, '0', 'X', 'g') AS rg,
        regexp_replace(s, '([0-9])([0-9])', '\\2-\\1') AS rb, 'a ' || s || ' "' || s || '" ''' || g || ''' %' AS f FROM {_S}"""
)
def string_building(spark: SparkSession, folder: str) -> DataFrame:
    t = _s(spark, folder)
    positive = F.when(t.i > 0, t.i)
    out = {
        "c": call("concat", t.s, positive), "cw": call("concat_ws", F.lit("/"), t.s, positive, t.g), "sp": call("split_part", t.s, F.lit("0"), F.lit(2)), "ch": call("chr", F.abs(t.i) + 960),
        "hx": F.when(t.i > 0, call("to_hex", t.i)).otherwise("n"), "qi": call("quote_ident", t.s), "qi2": call("quote_ident", t.g), "ql": call("quote_literal", F.concat(t.g, F.lit("'s"))),
        "r1": strings.regexp_replace(t.s, "0", "X"), "rg": strings.regexp_replace(t.s, "0", "X", "g"), "rb": strings.regexp_replace(t.s, "([0-9])([0-9])", r"\2-\1"),
        "f": strings.formatted("a %s %I %L %%", t.s, t.s, t.g),
    }
    return t.select("k", *(v.alias(n) for n, v in out.items()))


@query(
    f"""SELECT k, CAST(len(string_split(s, '0')) AS INTEGER) AS n, array_to_string(string_split(s, '0'), '|') AS j, CAST(0 AS INTEGER) AS none,
        array_to_string([g, coalesce(CASE WHEN i > 0 THEN s END, '?')], ',') AS jn, CASE WHEN i > 0 THEN g || ',' || s ELSE g END AS js FROM {_S}"""
)
def string_arrays(spark: SparkSession, folder: str) -> DataFrame:
    t = _s(spark, folder)
    parts, pair = strings.string_to_array(t.s, "0"), F.array(t.g, F.when(t.i > 0, t.s))
    return t.select("k", F.size(parts).alias("n"), strings.array_to_string(parts, "|").alias("j"), F.size(strings.string_to_array(F.lit(""), "0")).alias("none"), strings.array_to_string(pair, ",", "?").alias("jn"), strings.array_to_string(pair, ",").alias("js"))


@query(
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(len(embedding) AS INTEGER) AS u, 1 AS l, CAST(NULL AS INTEGER) AS none, CAST(0 AS INTEGER) AS c0,
       CAST(len(embedding) + 1 AS INTEGER) AS more, 1 AS one, 3 AS p, CAST(NULL AS BIGINT) AS absent FROM embeddings"""
)
def array_functions(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "embeddings")
    empty, none = F.expr("cast(array() as array<int>)"), F.lit(None).cast("array<int>")
    seven = F.array(F.lit(5), F.lit(6), F.lit(7))
    return e.select(
        "vec_id", call("array_length", e.embedding, F.lit(1)).alias("n"), call("array_upper", e.embedding).alias("u"), call("array_lower", e.embedding, F.lit(1)).alias("l"),
        call("array_length", empty).alias("none"), call("cardinality", empty).alias("c0"), F.size(call("array_append", e.embedding, F.lit(1.0).cast("float"))).alias("more"),
        F.size(call("array_append", none, F.lit(1))).alias("one"), call("array_position", seven, F.lit(7)).cast("int").alias("p"), call("array_position", seven, F.lit(8)).alias("absent"),
    )


_FIELDS = ("year", "month", "day", "hour", "minute", "dow", "isodow", "doy", "week", "quarter", "decade", "century", "isoyear")


@query(
    "SELECT event_id, " + ", ".join(f"CAST(date_part('{f}', ts) AS DOUBLE) AS {f}_" for f in _FIELDS)
    + ", CAST(epoch(ts) AS BIGINT) AS epoch_, CAST(date_part('second', ts) AS BIGINT) AS second_ FROM events"
)
def extract_fields(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    return e.select("event_id", *(datetimes.extract(f, e.ts).cast("double").alias(f"{f}_") for f in _FIELDS), K.to_integer(datetimes.date_part("epoch", e.ts), T.DoubleType(), "bigint").alias("epoch_"), F.floor(datetimes.extract("second", e.ts)).cast("bigint").alias("second_"))


_UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year", "decade")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP) AS {u}_" for u in _UNITS) + ", CASE WHEN year(o_orderdate) > 2000 THEN TIMESTAMP '2001-01-01 00:00:00' ELSE TIMESTAMP '1901-01-01 00:00:00' END AS century_ FROM orders")
def date_trunc_units(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    return o.select("o_orderkey", *(datetimes.date_trunc(u, o.o_orderdate).alias(f"{u}_") for u in (*_UNITS, "century")))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, strftime(ts, '%d.%m.%y') AS short, CAST(make_date(2000 + event_id % 20, 1 + event_id % 12, 28) AS DATE) AS d,
       CAST(date_diff('second', TIMESTAMP '2000-01-01 00:00:00', date_trunc('second', ts)) AS BIGINT) AS age_seconds, CAST(round(CAST(value AS DECIMAL(20,4)), 2) AS VARCHAR) AS money FROM events"""
)
def date_formatting(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    n = F.col("event_id")
    age = datetimes.age(F.date_trunc("second", e.ts), F.lit("2000-01-01").cast("timestamp_ntz"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', TIMESTAMP_NTZ'2000-01-01 00:00:00' + age)")
    rows = e.select(
        "event_id", datetimes.to_char(e.ts, "YYYY-MM-DD HH24:MI:SS").alias("c"), datetimes.to_char(e.ts, "DD.MM.YY").alias("short"),
        datetimes.make_date(2000 + n % 20, 1 + n % 12, F.lit(28)).alias("d"), age.alias("age"), datetimes.to_char_number(e.value.cast("decimal(20,4)"), "999990.00").alias("money"),
    )
    return rows.withColumn("age_seconds", seconds).drop("age")


@query("SELECT n_nationkey, true AS now_is_now, true AS same, 'public' AS schema, true AS v, 'UTC' AS zone, 'integer' AS t, 'text[]' AS ta, 36 AS uuid_length, true AS day FROM nation")
def session_functions(spark: SparkSession, folder: str) -> DataFrame:
    n = load(spark, folder, "nation")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return n.select(
        "n_nationkey", (call("now") > F.lit("2020-01-01").cast("timestamp")).alias("now_is_now"), (call("current_user") == call("session_user")).alias("same"), call("current_schema").alias("schema"),
        (F.length(call("version")) > 0).alias("v"), system.current_setting("spark.sql.session.timeZone").alias("zone"), call("pg_typeof", n.n_nationkey).alias("t"),
        call("pg_typeof", F.array(n.n_name)).alias("ta"), F.length(call("gen_random_uuid")).alias("uuid_length"), (call("current_date") > F.lit("2020-01-01").cast("date")).alias("day"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS b, CAST(o_orderkey * 0.125 AS DOUBLE) AS f FROM orders")
def boolean_and_numeric_input(spark: SparkSession, folder: str) -> DataFrame:
    o = load(spark, folder, "orders")
    words = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("off"))
    return o.select("o_orderkey", K.to_boolean(words).alias("b"), K.float_to_numeric(F.col("o_orderkey") * F.lit(0.125).cast("double"), "decimal(30,6)").cast("double").alias("f"))
