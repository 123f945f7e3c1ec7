"""SQL text with PostgreSQL's results, statements of a session, and sessions beside each other."""

from __future__ import annotations

import datetime
import decimal

import pytest

from tessera import dialect
from tessera.functions import call
from tessera.operators.tables import Column, Database, SqlError
from tessera.sql import Session

D = decimal.Decimal


@pytest.fixture(scope="module")
def values(spark):
    spark.sql(
        "SELECT * FROM VALUES (7, 2.5D, CAST(2.50 AS DECIMAL(5,2)), 5L, 'hello-world', CAST(NULL AS STRING)), (8, 3.5D, CAST(3.25 AS DECIMAL(5,2)), 6L, 'b', 'z') AS t(x, d, n, b, s, z)"
    ).createOrReplaceTempView("vals")


@pytest.mark.parametrize("sql, want", [
    ("regexp_replace('aaa','a','b')", "baa"), ("regexp_replace('aaa','A','b','gi')", "bbb"), ("concat('a',NULL)", "a"), ("round(2.5::float8)", 2.0), ("round(2.5)", D(3)), ("round(n, 1)", D("2.5")),
    ("x/2", 3), ("-x/2", -3), ("x/2.0::float8", 3.5), ("(x + 1) / (1 + 2)", 2), ("b / 2", 2), ("(b * 3)::int / 2", 7), ("initcap(s)", "Hello-World"), ("left('abc',-1)", "ab"), ("right('abc',-1)", "bc"), ("substr('abc',-1,3)", "a"),
    ("substring('abcdef' from 2 for 3)", "bcd"), ("to_hex(255)", "ff"), ("to_hex(-1)", "ffffffff"), ("chr(960)", "π"), ("chr(128512)", "😀"), ("trunc(2.7)", D(2)), ("trunc(-2.789, 2)", D("-2.78")), ("trunc(-d)", -2.0), ("trunc(1234, -2)", 1200),
    ("log(100)", 2.0), ("log(2, 8)", 3.0), ("ceil(d)", 3.0), ("ceil(n)", D(3)), ("floor(-n)", D(-3)), ("power(2.0, 3)", D(8)), ("2 ^ 3", 8.0), ("pg_typeof(n)", "numeric"), ("pg_typeof(ARRAY[1, 2])", "integer[]"), ("pg_typeof(x / 2)", "integer"),
    ("5 BETWEEN SYMMETRIC 7 AND 3", True), ("5 BETWEEN SYMMETRIC NULL AND 3", None), ("5 NOT BETWEEN SYMMETRIC 7 AND 3", False), ("x > ALL (SELECT 6)", True), ("x > ALL (SELECT b FROM vals WHERE false)", True), ("x = ANY (SELECT nullif(b, 5) FROM vals)", None),
    ("x IN (SELECT 7)", True), ("x NOT IN (SELECT nullif(b, 5) FROM vals)", None), ("'a ( b'", "a ( b"), ("(d + 0.1)::int", 3), ("(d + 1)::int", 4), ("2.5::numeric::int", 3), ("CAST(-2.5 AS integer)", -3),
    ("extract(dow from date '2024-01-07')", 0), ("to_char(date '2024-05-01','YYYY-MM')", "2024-05"), ("string_to_array('a,b',',')", ["a", "b"]), ("(ARRAY[1,2,3])[2]", 2), ("(ARRAY[1])[9]", None), ("quote_literal('it''s')", "'it''s'"), ("$$a'b$$", "a'b"), (r"E'a\tb'", "a\tb"),
    ("timestamp '2024-07-01 12:00:00' AT TIME ZONE 'America/New_York'", datetime.datetime(2024, 7, 1, 16)), ("timestamptz '2024-07-01 12:00:00' AT TIME ZONE 'America/New_York'", datetime.datetime(2024, 7, 1, 8)),
    ("array_length(string_to_array('', ','), 1)", None), ("split_part('a,b', ',', 2)", "b"), ("format('%s-%I', 'a', 'B c')", 'a-"B c"'), ("(SELECT max(x / 2) FROM vals)", 4),
])
def test_expressions(spark, values, sql, want):
    got = dialect.run(spark, f"SELECT {sql} AS r FROM vals ORDER BY x LIMIT 1").first()[0]
    assert got == want and (want is None or isinstance(got, type(want)))


@pytest.mark.parametrize("sql, want", [
    ("SELECT array_agg(z ORDER BY x DESC) a, string_agg(s, '+' ORDER BY x) b, sum(b) c, array_agg(z) IS NOT NULL d, sum(x) FILTER (WHERE x > 7) e FROM vals", [(["z", None], "hello-world+b", D(11), True, 8)]),
    ("SELECT array_agg(x) a, string_agg(s, ',') b FROM vals WHERE false", [(None, None)]), ("SELECT avg(x) a FROM vals", [(D("7.5"),)]),
    ("SELECT * FROM generate_series(1, 3) AS g(i)", [(1,), (2,), (3,)]), ("SELECT g FROM generate_series(5, 1, -2) g", [(5,), (3,), (1,)]), ("SELECT * FROM generate_series(3, 1) g", []),
    ("SELECT x, i FROM vals, generate_series(1, 2) i ORDER BY 1, 2", [(7, 1), (7, 2), (8, 1), (8, 2)]), ("SELECT v FROM generate_series(1.0, 2.0, 0.5) t(v)", [(D(1),), (D("1.5"),), (D(2),)]),
    ("SELECT u FROM unnest(ARRAY[3, 1]) AS t(u) ORDER BY u", [(1,), (3,)]), ("SELECT DISTINCT ON (x) x, s FROM vals ORDER BY x, s", [(7, "hello-world"), (8, "b")]),
    ("WITH w AS (SELECT x / 2 AS h FROM vals) SELECT sum(h) s FROM w", [(7,)]), ("SELECT count(*) n FROM vals WHERE x / 2 = 3 AND EXISTS (SELECT 1 FROM vals u WHERE u.x / 2 = vals.x / 2)", [(1,)]),
])
def test_queries(spark, values, sql, want):
    assert [tuple(r) for r in dialect.run(spark, sql).collect()] == want


@pytest.mark.parametrize("sql", ["SELECT 1 +", "SELECT log(0)", "SELECT sqrt(-1)", "SELECT chr(0)", "SELECT substr('a', 1, -1)", "SELECT split_part('a', ',', 0)", "SELECT 1 / 0", "SELECT concat_ws(", "SELECT 'open"])
def test_errors(spark, sql):
    with pytest.raises(Exception):  # noqa: B017  a state of the dialect's, or of Spark's when the query runs
        dialect.run(spark, sql).collect()


def test_builders_choose_by_type(spark):
    row = spark.sql("SELECT -1 AS i, -1L AS l").select(call("to_hex", dialect_column("i")), call("to_hex", dialect_column("l"))).first()
    assert tuple(row) == ("f" * 8, "f" * 16)


def dialect_column(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, Database(spark, str(tmp_path / "db")))


def rows(session, sql, *values):
    return sorted((tuple(r) for r in session.query(sql, *values).collect()), key=repr)


@pytest.mark.parametrize("sql, state", [
    ("INSERT INTO p VALUES (1, 'x')", "23505"), ("INSERT INTO p VALUES (5, NULL)", "23502"), ("INSERT INTO p VALUES (-5, 'x')", "23514"), ("INSERT INTO c (p) VALUES (99)", "23503"), ("DELETE FROM p WHERE id = 1", "23503"),
    ("UPDATE p SET nosuch = 1", "42703"), ("INSERT INTO nobody VALUES (1)", "42P01"), ("CREATE TABLE p (id int)", "42P07"), ("INSERT INTO p (id, v) VALUES (7, 'a'), (7, 'b')", "23505"), ("DROP TABLE p", "2BP01"),
    ("INSERT INTO p VALUES (1, 'x'), (1, 'y') ON CONFLICT (id) DO UPDATE SET v = excluded.v", "21000"), ("EXECUTE nothing", "26000"), ("SELECT currval('fresh')", "55000"), ("DROP INDEX nothing", "42704"),
])
def test_states(session, sql, state):
    session.script("CREATE TABLE p (id int PRIMARY KEY, v varchar(3) NOT NULL, CHECK (id > 0)); CREATE TABLE c (id serial, p int REFERENCES p); INSERT INTO p VALUES (1, 'a'), (2, 'b'); INSERT INTO c (p) VALUES (1); CREATE SEQUENCE fresh")
    with pytest.raises(SqlError) as e:
        session.execute(sql)
    assert e.value.state == state
    assert rows(session, "SELECT * FROM p") == [(1, "a"), (2, "b")]


def test_returned_rows_have_the_columns_types(session):
    session.script("CREATE TABLE t (id int PRIMARY KEY, a numeric(12,2), s char(3)); INSERT INTO t VALUES (1, 1.005, 'x'), (2, 5, 'yy')")
    assert rows(session, "UPDATE t SET a = a / 2, s = 'q' WHERE id = 1 RETURNING a, s, t.id + 1 AS n") == [(D("0.51"), "q  ", 2)]
    assert rows(session, "SELECT id FROM t WHERE a > $1 AND s = $2", 1, "yy ") == [(2,)]


def test_a_failed_transaction_takes_no_more(session):
    session.script("CREATE TABLE t (id int PRIMARY KEY); BEGIN; INSERT INTO t VALUES (1)")
    with pytest.raises(SqlError):
        session.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(SqlError) as e:
        session.execute("INSERT INTO t VALUES (2)")
    assert e.value.state == "25P02" and session.execute("COMMIT").tag == "ROLLBACK" and rows(session, "SELECT * FROM t") == []
    session.execute("BEGIN READ ONLY")
    with pytest.raises(SqlError) as e:
        session.execute("INSERT INTO t VALUES (2)")
    assert e.value.state == "25006"
    session.execute("ROLLBACK")


def test_vacuum_leaves_what_open_transactions_wrote(spark, tmp_path):
    one = Session(spark, Database(spark, str(tmp_path / "db")))
    one.script("CREATE TABLE t (id int PRIMARY KEY); INSERT INTO t VALUES (1)")
    two = Session(spark, Database(spark, one.db.root))
    two.script("BEGIN; INSERT INTO t VALUES (2)")
    one.execute("VACUUM")
    assert two.db.vacuum(horizon=0) == 0  # its own transaction's rows stay whatever their age
    two.execute("COMMIT")
    assert rows(one, "SELECT * FROM t") == [(1,), (2,)]
    one.execute("DELETE FROM t WHERE id = 1")
    assert one.db.vacuum(horizon=0) == 2 and rows(two, "SELECT * FROM t") == [(2,)]


def test_a_version_is_published_once(spark, tmp_path):
    one = Database(spark, str(tmp_path / "db"))
    one.create_table("t", [Column("id", "int")])
    taken = one.at_version(one.versions()[-1])
    with pytest.raises(SqlError) as e:
        one._publish(taken)
    assert e.value.state == "40001" and one.at_version(taken["version"]) == taken
    assert not [f for f in (tmp_path / "db" / "_catalog").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_two_writers_of_one_table(spark, tmp_path):
    one, two = (Session(spark, Database(spark, str(tmp_path / "db"))) for _ in range(2))
    one.script("CREATE TABLE t (id int PRIMARY KEY, v int); INSERT INTO t VALUES (1, 1)")
    one.script("BEGIN ISOLATION LEVEL REPEATABLE READ; UPDATE t SET v = 2")
    two.execute("UPDATE t SET v = 3")
    with pytest.raises(SqlError) as e:
        one.execute("COMMIT")
    assert e.value.state == "40001" and rows(one, "SELECT * FROM t") == [(1, 3)]
    one.execute("BEGIN")
    two.execute("INSERT INTO t VALUES (5, 5)")
    assert one.execute("UPDATE t SET v = v + 1").tag == "UPDATE" and one.execute("COMMIT").tag == "COMMIT"
    assert rows(two, "SELECT * FROM t") == [(1, 4), (5, 6)]


def test_statistics_of_a_sample(spark, tmp_path, monkeypatch):
    from tessera.operators import tables

    monkeypatch.setattr(tables, "SAMPLE", 500)
    db = Database(spark, str(tmp_path / "db"))
    db.create_table_as("t", spark.sql("SELECT id, CAST(id % 7 AS INT) AS few, IF(id % 4 = 0, NULL, 'x') AS s FROM range(5000)"))
    about = {a["column"]: a for a in db.analyze("t")}
    assert 3000 < about["id"]["n_distinct"] <= 5500 and about["few"]["n_distinct"] == 7 and abs(about["s"]["null_frac"] - 0.25) < 0.08
    assert len(about["few"]["common"]) == 7 and about["id"]["bounds"] == sorted(about["id"]["bounds"])


def test_a_statement_starts_again_on_what_another_writer_did(spark, tmp_path, monkeypatch):
    one, two = (Session(spark, Database(spark, str(tmp_path / "db"))) for _ in range(2))
    one.script("CREATE TABLE t (id int PRIMARY KEY, v int); INSERT INTO t VALUES (1, 1), (2, 1)")
    commit, raced = one.db.commit, []

    def late():
        if not raced:
            raced.append(True)
            two.execute("UPDATE t SET v = 5 WHERE id = 1")
        commit()

    monkeypatch.setattr(one.db, "commit", late)
    assert rows(one, "UPDATE t SET v = v + 1 WHERE v < 5 RETURNING id, v") == [(2, 2)]
    assert raced and rows(two, "SELECT * FROM t") == [(1, 5), (2, 2)]


def test_only_files_with_hits_are_written_anew(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    s = Session(spark, db)
    s.script("CREATE TABLE t (id bigint PRIMARY KEY, v int)")
    for lo in (0, 100, 200):
        db.insert("t", spark.range(lo, lo + 100).selectExpr("id", "0"))
    files = lambda: {f.rsplit("/", 1)[1] for f in db.table("t").inputFiles()}
    first = files()
    s.execute("UPDATE t SET v = 1 WHERE id = 150")
    kept = files() & first
    assert 0 < len(first - kept) <= 4 and len(kept) >= len(first) - 4
    s.execute("DELETE FROM t WHERE id = 250")
    s.execute("DELETE FROM t WHERE id = 9999")
    assert rows(s, "SELECT count(*) n, sum(v) v, sum(id) i FROM t") == [(299, 1, D(sum(range(300)) - 250))]
    assert db.vacuum(horizon=0) > 0 and rows(s, "SELECT count(*) n FROM t") == [(299,)]
    s.script("ALTER TABLE t RENAME COLUMN v TO w; UPDATE t SET w = w + 1 WHERE id < 3; DELETE FROM t WHERE id = 0")
    assert rows(s, "SELECT sum(w) w, count(*) n FROM t") == [(3, 298)]


def test_copy_through_the_session(session):
    session.execute("CREATE TABLE t (id int PRIMARY KEY, s text, ok boolean)")
    session.execute("COPY t FROM STDIN", data="1\ta\\tb\tt\n2\t\\N\tf\n\\.\n")
    session.execute("COPY t (id, s) FROM STDIN WITH (FORMAT csv, HEADER)", data='id,s\n3,"x, y"\n4,\n5,""\n')
    assert rows(session, "SELECT * FROM t") == [(1, "a\tb", True), (2, None, False), (3, "x, y", None), (4, None, None), (5, "", None)]
    assert rows(session, "COPY t TO STDOUT") == [("1\ta\\tb\tt",), ("2\t\\N\tf",), ("3\tx, y\t\\N",), ("4\t\\N\t\\N",), ("5\t\t\\N",)]
    assert rows(session, "COPY (SELECT id + 1, s FROM t WHERE id = 3) TO STDOUT (FORMAT csv)") == [('4,"x, y"',)]
    with pytest.raises(SqlError) as e:
        session.execute("COPY t FROM STDIN")
    assert e.value.state == "08P01" and session.execute("NOTIFY a, 'b'").tag == "NOTIFY"
