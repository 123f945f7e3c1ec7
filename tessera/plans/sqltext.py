"""Statements as text: functions, operators and table functions through the dialect, and
scripts of statements through a session, each against its SQL on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dialect
from ..scratch import scratch_path
from ..sources import TABLES, register_views
from ..sql import Session
from .registry import ORACLE, QUERIES


def _views(spark: SparkSession, folder: str, text: str) -> None:
    register_views(spark, folder, *(t for t in TABLES if t in text.lower()))


def _plain(rows: DataFrame) -> DataFrame:
    """Numeric columns as doubles."""
    return rows.select(*(F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.simpleString().startswith("decimal") else F.col(f"`{f.name}`") for f in rows.schema))


def text(name: str, sql: str, other_sql: str) -> None:
    """Register a query's text under the dialect."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        _views(spark, folder, sql)
        return _plain(dialect.run(spark, sql))

    QUERIES[name], ORACLE[name] = run, other_sql


def script(name: str, statements: str, last: str, other_sql: str) -> None:
    """Register statements and the query that shows what they did; ``{path}`` is a fresh folder."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        _views(spark, folder, statements + last)
        session, path = Session(spark), scratch_path(spark, name)
        session.script(statements.replace("{path}", path))
        return _plain(session.query(last))

    QUERIES[name], ORACLE[name] = run, other_sql


text(
    "sql_integer_division",
    "SELECT c_custkey, c_custkey / 7 AS q, -c_custkey / 7 AS nq, (c_nationkey + 1) / 2 AS h, c_custkey % 7 AS r, (c_nationkey * 3)::int / 2 AS w FROM customer",
    "SELECT c_custkey, CAST(trunc(c_custkey / 7) AS BIGINT) AS q, CAST(trunc(-c_custkey / 7) AS BIGINT) AS nq, CAST(trunc((c_nationkey + 1) / 2) AS BIGINT) AS h, c_custkey % 7 AS r, CAST(trunc(c_nationkey * 3 / 2) AS BIGINT) AS w FROM customer",
)
text(
    "sql_string_functions",
    r"""SELECT c_custkey, initcap(replace(lower(c_name), '#', ' x')) AS i, left(c_name, -3) AS l, right(c_name, -3) AS r, substr(c_name, -1, 4) AS s, substring(c_name from 3 for 4) AS sf, to_hex(c_custkey) AS h,
        chr(200 + (c_custkey % 500)::int) AS c, concat(c_name, NULL, c_custkey) AS k, regexp_replace(c_name, '0', 'x') AS one, regexp_replace(c_name, '(\d)$', '<\1>', 'g') AS g, strpos(c_name, '#') AS p,
        split_part(c_name, '#', 2) AS sp, ltrim(c_name, 'Cu') AS lt, btrim(c_mktsegment, 'BAG') AS b, format('%s:%I:%L', c_custkey, 'a B', c_name) AS f, quote_literal(c_name) AS ql, starts_with(c_name, 'Cust') AS w FROM customer""",
    r"""SELECT c_custkey, 'Customer X' || right(c_name, 9) AS i, left(c_name, length(c_name) - 3) AS l, right(c_name, length(c_name) - 3) AS r, left(c_name, 2) AS s, substring(c_name, 3, 4) AS sf, printf('%x', c_custkey) AS h,
        chr(CAST(200 + c_custkey % 500 AS INTEGER)) AS c, c_name || c_custkey AS k, regexp_replace(c_name, '0', 'x') AS one, left(c_name, length(c_name) - 1) || '<' || right(c_name, 1) || '>' AS g, strpos(c_name, '#') AS p,
        split_part(c_name, '#', 2) AS sp, ltrim(c_name, 'Cu') AS lt, trim(c_mktsegment, 'BAG') AS b, c_custkey || ':"a B":''' || c_name || '''' AS f, '''' || c_name || '''' AS ql, starts_with(c_name, 'Cust') AS w FROM customer""",
)
text(
    "sql_math_functions",
    """SELECT p_partkey, round(p_size / 2.0::float8) AS even, round(p_size / 4.0, 1) AS half_up, trunc(-p_size / 4.0::float8) AS cut, trunc(p_size / 8.0, 2) AS cut2, ceil(p_size / 4.0::float8) AS up, floor(-p_size / 4.0::float8) AS down,
       ceil(p_size) AS whole, log(p_size) AS l10, log(2, p_size) AS l2, power(p_size, 2) AS sq, div(p_size, 7) AS d, mod(p_size, 7) AS m, (p_size / 4.0::float8)::int AS to_int, abs(p_size - 25) AS a, p_size ^ 2 AS hat FROM part WHERE p_size > 0""",
    """SELECT p_partkey, round_even(p_size / 2.0, 0) AS even, CAST(round(CAST(p_size AS DECIMAL(9,4)) / 4, 1) AS DOUBLE) AS half_up, trunc(-p_size / 4.0) AS cut, trunc(p_size * 100 / 8.0) / 100 AS cut2, ceil(p_size / 4.0) AS up, floor(-p_size / 4.0) AS down,
       CAST(p_size AS DOUBLE) AS whole, log10(p_size) AS l10, ln(p_size) / ln(2) AS l2, CAST(p_size * p_size AS DOUBLE) AS sq, CAST(trunc(p_size / 7) AS DOUBLE) AS d, p_size % 7 AS m, CAST(round_even(p_size / 4.0, 0) AS INTEGER) AS to_int, abs(p_size - 25) AS a,
       CAST(p_size * p_size AS DOUBLE) AS hat FROM part WHERE p_size > 0""",
)
text(
    "sql_aggregates",
    """SELECT c_nationkey AS n, array_agg(nullif(c_custkey % 3, 1) ORDER BY c_custkey) AS a, array_agg(c_custkey ORDER BY c_custkey DESC) FILTER (WHERE c_custkey % 2 = 0) AS e, sum(c_custkey) AS s, avg(c_custkey) AS v,
       string_agg(c_mktsegment, '+' ORDER BY c_custkey) AS t, count(*) FILTER (WHERE c_acctbal > 0) AS f, bool_and(c_custkey > 0) AS b, sum(DISTINCT c_custkey % 5) AS d FROM customer GROUP BY 1""",
    """SELECT c_nationkey AS n, list(nullif(c_custkey % 3, 1) ORDER BY c_custkey) AS a, list(c_custkey ORDER BY c_custkey DESC) FILTER (WHERE c_custkey % 2 = 0) AS e, CAST(sum(c_custkey) AS DOUBLE) AS s, avg(c_custkey) AS v,
       string_agg(c_mktsegment, '+' ORDER BY c_custkey) AS t, count(*) FILTER (WHERE c_acctbal > 0) AS f, bool_and(c_custkey > 0) AS b, CAST(sum(DISTINCT c_custkey % 5) AS DOUBLE) AS d FROM customer GROUP BY 1""",
)
text(
    "sql_series_and_unnest",
    "SELECT n_nationkey AS k, i, u FROM nation, generate_series(1, n_regionkey) AS g(i), unnest(ARRAY[n_nationkey, n_regionkey]) AS t(u) UNION ALL SELECT -1, x, 0 FROM generate_series(9, 1, -4) x",
    "SELECT n_nationkey AS k, i, u FROM nation, generate_series(1, n_regionkey) AS g(i), unnest([n_nationkey, n_regionkey]) AS t(u) UNION ALL SELECT * FROM (VALUES (-1, 9, 0), (-1, 5, 0), (-1, 1, 0)) v",
)
text(
    "sql_any_all_subquery",
    """SELECT n_nationkey AS k, n_regionkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 2) AS a, n_regionkey >= ANY (SELECT nullif(r_regionkey, 0) FROM region) AS b, n_regionkey < ALL (SELECT r_regionkey FROM region WHERE false) AS c,
       n_nationkey <> ALL (SELECT s_nationkey FROM supplier) AS d, n_regionkey = ANY (SELECT nullif(r_regionkey, 1) FROM region) AS e, n_regionkey <> SOME (SELECT 3) AS f FROM nation WHERE n_nationkey + 1 > ANY (SELECT r_regionkey FROM region)""",
    """SELECT n_nationkey AS k, n_regionkey > 1 AS a, CASE WHEN n_regionkey >= 1 THEN true END AS b, true AS c, NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS d,
       CASE WHEN n_regionkey <> 1 THEN true END AS e, n_regionkey <> 3 AS f FROM nation""",
)
text(
    "sql_between_symmetric",
    "SELECT p_partkey, p_size + 1 BETWEEN SYMMETRIC 30 AND nullif(p_partkey % 40, 7) AS y, p_size NOT BETWEEN SYMMETRIC 30 AND nullif(p_partkey % 40, 7) AS n FROM part",
    """SELECT p_partkey, (p_size + 1 BETWEEN 30 AND m) OR (p_size + 1 BETWEEN m AND 30) AS y, NOT ((p_size BETWEEN 30 AND m) OR (p_size BETWEEN m AND 30)) AS n
       FROM (SELECT *, nullif(p_partkey % 40, 7) AS m FROM part) p""",
)
text(
    "sql_at_time_zone",
    "SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo' AS there, (ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS back, timestamp '2024-07-01 12:00:00' AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS summer FROM events",
    "SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 9 HOUR AS there, CAST(ts AS TIMESTAMP) - INTERVAL 9 HOUR AS back, TIMESTAMP '2024-07-01 16:00:00' AS summer FROM events",
)
text(
    "sql_date_functions",
    """SELECT o_orderkey, extract(dow from o_orderdate) AS dow, extract(isodow from o_orderdate) AS isodow, date_part('year', o_orderdate) AS y, extract(epoch from o_orderdate) AS e, date_trunc('month', o_orderdate) AS m,
       to_char(o_orderdate, 'YYYY/MM/DD') AS c, make_date(1996, 2, 28) + 1 AS leap, extract(milliseconds from timestamp '2024-01-01 00:00:01.5') AS ms FROM orders""",
    """SELECT o_orderkey, date_part('dow', o_orderdate) AS dow, date_part('isodow', o_orderdate) AS isodow, CAST(year(o_orderdate) AS DOUBLE) AS y, epoch(o_orderdate) AS e, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m,
       strftime(o_orderdate, '%Y/%m/%d') AS c, DATE '1996-02-29' AS leap, 1500.0 AS ms FROM orders""",
)
text(
    "sql_session_values",
    """SELECT n_nationkey, statement_timestamp() = transaction_timestamp() AS same, clock_timestamp() >= now() AS clock, localtimestamp > timestamp '2020-01-01 00:00:00' AS local, user = current_user AS u, current_role = session_user AS r,
       current_database() = current_catalog AS d, current_schema AS s, current_schemas(true) AS ss, pg_typeof(n_name) AS t, length(gen_random_uuid()) AS len FROM nation""",
    "SELECT n_nationkey, true AS same, true AS clock, true AS local, true AS u, true AS r, true AS d, 'public' AS s, ['public'] AS ss, 'text' AS t, 36 AS len FROM nation",
)
text(
    "sql_predicates",
    r"""SELECT p_partkey, p_name ~* '^[a-m]' AS a, p_type !~ 'STEEL' AS b, p_size IN (SELECT n_nationkey FROM nation) AS c, (p_size, 1) < (20, 2) AS d, p_size = ANY (ARRAY[1, 2, 3]) AS e, p_size IS DISTINCT FROM nullif(p_size, 5) AS f,
        CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_size) THEN 'x' ELSE 'y' END AS g FROM part""",
    r"""SELECT p_partkey, regexp_matches(p_name, '(?i)^[a-m]') AS a, NOT regexp_matches(p_type, 'STEEL') AS b, p_size IN (SELECT n_nationkey FROM nation) AS c, (p_size < 20 OR (p_size = 20 AND 1 < 2)) AS d, p_size IN (1, 2, 3) AS e, p_size = 5 AS f,
        CASE WHEN p_size IN (SELECT n_nationkey FROM nation) THEN 'x' ELSE 'y' END AS g FROM part""",
)

_CUSTOMERS = """CREATE TABLE t (id bigint PRIMARY KEY, name text NOT NULL, nation int, balance numeric(12,2) DEFAULT 0, CHECK (id > -100));
    INSERT INTO t SELECT c_custkey, c_name, c_nationkey, c_acctbal::numeric(12,2) FROM customer;"""
_ALL = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance FROM customer"

script(
    "sql_insert_update_delete",
    f"""{_CUSTOMERS}
    INSERT INTO t (id, name) VALUES (-1, 'a' || 'b'), (-2, DEFAULT || 'c');
    """.replace("DEFAULT || 'c'", "upper('c')")
    + """UPDATE t SET name = upper(t.name), balance = t.balance / 2 WHERE id / 2 = 3;
    UPDATE t AS c SET name = n_name, nation = DEFAULT FROM nation WHERE c.nation = n_nationkey AND n_regionkey = 1;
    DELETE FROM t USING nation JOIN region ON n_regionkey = r_regionkey WHERE nation = n_nationkey AND r_name = 'ASIA';
    DELETE FROM t WHERE id IN (SELECT s_suppkey FROM supplier) AND balance < 0""",
    "SELECT * FROM t",
    """SELECT id, CASE WHEN r = 1 THEN n_name WHEN id IN (6, 7) THEN upper(name) ELSE name END AS name, CASE WHEN r <> 1 THEN nation END AS nation, b AS balance FROM (
         SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, n_name, n_regionkey AS r, CAST(CASE WHEN c_custkey IN (6, 7) THEN round(CAST(c_acctbal AS DECIMAL(12,2)) / 2, 2) ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS DOUBLE) AS b
         FROM customer JOIN nation ON c_nationkey = n_nationkey) x
       WHERE r NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') AND NOT (id IN (SELECT s_suppkey FROM supplier) AND b < 0)
       UNION ALL SELECT * FROM (VALUES (-1, 'ab', NULL, 0.0), (-2, 'C', NULL, 0.0)) v""",
)
script(
    "sql_on_conflict",
    f"""{_CUSTOMERS}
    INSERT INTO t VALUES (1, 'x', 1), (-5, 'new', 2) ON CONFLICT DO NOTHING;
    INSERT INTO t (id, name, balance) SELECT c_custkey, c_name || '!', 7 FROM customer WHERE c_custkey % 10 = 0 ON CONFLICT (id) DO UPDATE SET name = excluded.name, balance = t.balance + excluded.balance WHERE t.balance > 0""",
    "SELECT * FROM t",
    f"""SELECT id, CASE WHEN id % 10 = 0 AND balance > 0 THEN name || '!' ELSE name END AS name, nation, CASE WHEN id % 10 = 0 AND balance > 0 THEN round(balance + 7, 2) ELSE balance END AS balance FROM ({_ALL}) a
        UNION ALL SELECT -5, 'new', 2, 0.0""",
)


def sql_returning(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of RETURNING of three statements, DEFAULT VALUES included."""
    _views(spark, folder, "customer")
    s = Session(spark)
    s.script("CREATE TABLE t (id serial PRIMARY KEY, v bigint DEFAULT 4); INSERT INTO t (v) SELECT c_custkey FROM customer ORDER BY c_custkey")
    got = [s.query(q) for q in ("INSERT INTO t DEFAULT VALUES RETURNING 'i' AS op, v", "UPDATE t SET v = -v WHERE v % 100 = 1 RETURNING 'u' AS op, t.v", "DELETE FROM t WHERE v % 100 = 2 RETURNING 'd' AS op, v")]
    return got[0].unionAll(got[1]).unionAll(got[2])


QUERIES["sql_returning"] = sql_returning
ORACLE["sql_returning"] = "SELECT 'i' AS op, CAST(4 AS BIGINT) AS v UNION ALL SELECT 'u', -c_custkey FROM customer WHERE c_custkey % 100 = 1 UNION ALL SELECT 'd', c_custkey FROM customer WHERE c_custkey % 100 = 2"

script(
    "sql_definitions",
    """CREATE TABLE n (id int, name varchar(25) NOT NULL, CONSTRAINT pk PRIMARY KEY (id));
    CREATE TABLE s (id bigserial PRIMARY KEY, n int REFERENCES n (id) ON DELETE SET NULL ON UPDATE CASCADE, name text UNIQUE);
    INSERT INTO n SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20;
    ALTER TABLE n ADD COLUMN flag text DEFAULT 'old';
    ALTER TABLE n RENAME COLUMN name TO title;
    ALTER TABLE n RENAME TO nations;
    INSERT INTO nations SELECT n_nationkey, n_name, 'late' FROM nation WHERE n_nationkey >= 20;
    ALTER TABLE nations ADD CONSTRAINT c CHECK (flag IN ('old', 'late'));
    CREATE INDEX ON nations (title);
    INSERT INTO s (n, name) SELECT s_nationkey, s_name FROM supplier;
    DELETE FROM nations WHERE id = 3;
    UPDATE nations SET id = 100 WHERE id = 4;
    CREATE TABLE copied AS SELECT nations.id, title, flag, count(s.id) AS suppliers FROM nations LEFT JOIN s ON s.n = nations.id GROUP BY 1, 2, 3;
    CREATE SEQUENCE q START WITH 7 INCREMENT BY 3;
    TRUNCATE TABLE s;
    DROP TABLE s;
    DROP TABLE IF EXISTS nobody""",
    "SELECT *, nextval('q') AS q, (SELECT count(*) FROM information_schema.columns WHERE table_name IN ('nations', 's')) AS cols FROM copied",
    """SELECT CASE WHEN n_nationkey = 4 THEN 100 ELSE n_nationkey END AS id, n_name AS title, CASE WHEN n_nationkey >= 20 THEN 'late' ELSE 'old' END AS flag, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, 7 AS q, 3 AS cols
       FROM nation WHERE n_nationkey <> 3""",
)
script(
    "sql_copy",
    f"""{_CUSTOMERS}
    CREATE TABLE u (id bigint, name text);
    COPY t (id, name) TO '{{path}}/a' WITH (FORMAT csv, HEADER);
    COPY u FROM '{{path}}/a' (FORMAT csv, HEADER true);
    COPY (SELECT -id, upper(name) FROM t) TO '{{path}}/b';
    COPY u FROM '{{path}}/b'""",
    "TABLE u",
    "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT -c_custkey, upper(c_name) FROM customer",
)
script(
    "sql_transactions",
    f"""{_CUSTOMERS}
    BEGIN; DELETE FROM t; ROLLBACK;
    BEGIN ISOLATION LEVEL REPEATABLE READ; UPDATE t SET balance = 1 WHERE id % 2 = 0; INSERT INTO t VALUES (-3, 'z', 1); COMMIT""",
    "SELECT * FROM t",
    f"SELECT id, name, nation, CASE WHEN id % 2 = 0 THEN 1.0 ELSE balance END AS balance FROM ({_ALL}) a UNION ALL SELECT -3, 'z', 1, 0.0",
)


def sql_settings(spark: SparkSession, folder: str) -> DataFrame:
    """SET, SHOW and RESET of the planner's switches, PREPARE and EXECUTE, EXPLAIN ANALYZE."""
    _views(spark, folder, "nation")
    s, rows = Session(spark), []
    for name in ("enable_hashjoin", "enable_mergejoin", "enable_nestloop", "enable_indexscan", "enable_seqscan"):
        for command in (f"SET {name} = off", f"RESET {name}"):
            s.execute(command)
            rows.append((name, s.query(f"SHOW {name}").first()[0], 0))
    s.script("PREPARE p (int) AS SELECT n_name FROM nation WHERE n_regionkey = $1")
    rows.append(("execute", "on", s.query("EXECUTE p(2)").count()))
    s.execute("DEALLOCATE p")
    lines = [r[0] for r in s.query("EXPLAIN ANALYZE SELECT * FROM nation").collect()]
    rows.append(("explain", "on", int(next(line for line in lines if line.startswith("Rows: "))[6:])))
    return spark.createDataFrame(rows, "name string, value string, n long")


QUERIES["sql_settings"] = sql_settings
ORACLE["sql_settings"] = """SELECT name, value, CAST(0 AS BIGINT) AS n FROM (VALUES ('enable_hashjoin'), ('enable_mergejoin'), ('enable_nestloop'), ('enable_indexscan'), ('enable_seqscan')) a(name), (VALUES ('on'), ('off')) b(value)
    UNION ALL SELECT 'execute', 'on', count(*) FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'explain', 'on', count(*) FROM nation"""
