"""Table-layer statements: each query runs a script of statements and returns a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import Column, Conflict, Database, ForeignKey, SqlError
from ..scratch import scratch_path
from ..sources import load
from .registry import query


def _database(spark: SparkSession) -> Database:
    return Database(spark, scratch_path(spark, "database"))


def _customers(spark: SparkSession, folder: str, *more: Column, key: Sequence[str] = ("id",), **options) -> Database:
    db = _database(spark)
    columns = [Column("id", "bigint"), Column("name", "text", not_null=True), Column("nation", "int"), Column("balance", "numeric(12,2)", default="0"), *more]
    db.create_table("customers", columns, primary_key=key, **options)
    c = load(spark, folder, "customer")
    db.insert("customers", c.select("c_custkey", "c_name", "c_nationkey", c.c_acctbal.cast("decimal(12,2)")))
    return db


def _out(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast("double").alias(f.name) if f.dataType.simpleString().startswith("decimal") else F.col(f.name) for f in rows.schema))


_ALL = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance FROM customer"


@query(f"{_ALL} UNION ALL SELECT * FROM (VALUES (900001, 'new', 3, 0.0), (900002, 'newer', NULL, 0.0)) t")
def insert_values_select_defaults(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    db.insert("customers", [(900001, "new", 3), (900002, "newer", None)], ["id", "name", "nation"])
    return _out(db.table("customers"))


@query("SELECT c_custkey AS id, CAST(round(CAST(c_acctbal AS DECIMAL(12,2)) * 2, 2) AS DOUBLE) AS balance FROM customer WHERE c_nationkey = 5")
def update_returning(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    return _out(db.update("customers", {"balance": "balance * 2", "name": "upper(name)"}, "nation = 5", returning=["id", "balance"]))


@query("SELECT c_custkey AS id, CASE WHEN r_name = 'ASIA' THEN 'ASIA' ELSE c_name END AS name, c_nationkey AS nation, CAST(CASE WHEN r_name = 'ASIA' THEN 1 ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def update_from(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    source = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name = 'ASIA'")
    db.update("customers", {"name": "r_name", "balance": "1"}, "nation = n_nationkey", source=source)
    return _out(db.table("customers"))


@query(f"{_ALL} WHERE NOT (c_acctbal < 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")
def delete_using(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    db.delete("customers", "nation = n_nationkey AND n_regionkey = 2 AND balance < 0", using=load(spark, folder, "nation"))
    return _out(db.table("customers"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey <= 20")
def delete_returning(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder).delete("customers", "id <= 20", returning=["id"])


@query(f"{_ALL} UNION ALL SELECT -1, 'fresh', 1, 5.0")
def on_conflict_do_nothing(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    db.insert("customers", [(1, "x", 1), (2, "y", 1)], ["id", "name", "nation"], conflict=Conflict())
    db.insert("customers", spark.sql("SELECT -1L AS id, 'fresh' AS name, 1 AS nation, CAST(5 AS DECIMAL(12,2)) AS balance UNION ALL SELECT 3L, 'z', 1, CAST(5 AS DECIMAL(12,2))"), conflict=Conflict())
    return _out(db.table("customers"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 AND c_acctbal > 0 THEN c_name || '!' ELSE c_name END AS name, c_nationkey AS nation,
       CAST(CASE WHEN c_custkey % 10 = 0 AND c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) + 7 ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS DOUBLE) AS balance FROM customer
       UNION ALL SELECT c_custkey + 500000, c_name || '!', 0, 7.0 FROM customer WHERE c_custkey % 100 = 0"""
)
def on_conflict_do_update(spark: SparkSession, folder: str) -> DataFrame:
    """``added`` is part of the key, as a new row's number may be a customer's too."""
    db = _customers(spark, folder, Column("added", "int", default="0"), key=["id", "added"])
    c = load(spark, folder, "customer")
    same = c.filter("c_custkey % 10 = 0").selectExpr("c_custkey", "c_name || '!'", "0", "CAST(7 AS DECIMAL(12,2))", "0")
    new = c.filter("c_custkey % 100 = 0").selectExpr("c_custkey + 500000", "c_name || '!'", "0", "CAST(7 AS DECIMAL(12,2))", "1")
    action = Conflict({"name": "excluded.name", "balance": "customers.balance + excluded.balance"}, "customers.balance > 0")
    db.insert("customers", same.union(new), conflict=action)
    return _out(db.table("customers").drop("added"))


@query(
    """SELECT * FROM (VALUES ('23502', 'null in a NOT NULL column'), ('23505', 'second row of a key'), ('23514', 'row against CHECK'), ('23503', 'child without parent'),
       ('23503', 'parent with child'), ('22001', 'long text'), ('42P01', 'no such table'), ('42703', 'no such column'), ('42P07', 'table there already'), ('21000', 'row hit twice')) t(state, what)"""
)
def constraint_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Each violation fails with its SQLSTATE and leaves the tables as they were."""
    db = _database(spark)
    db.create_table("parent", [Column("id", "int"), Column("v", "varchar(3)", not_null=True)], primary_key=["id"], checks=["id > 0"])
    db.create_table("child", [Column("id", "int"), Column("p", "int")], foreign_keys=[ForeignKey(["p"], "parent", ["id"])])
    db.insert("parent", [(1, "a"), (2, "b")])
    db.insert("child", [(10, 1), (11, None)])
    attempts = {
        "null in a NOT NULL column": lambda: db.insert("parent", [(3, None)]), "second row of a key": lambda: db.insert("parent", [(1, "c")]), "row against CHECK": lambda: db.insert("parent", [(-1, "c")]),
        "child without parent": lambda: db.insert("child", [(12, 7)]), "parent with child": lambda: db.delete("parent", "id = 1"), "long text": lambda: db.insert("parent", [(4, "abcd")]),
        "no such table": lambda: db.table("nobody"), "no such column": lambda: db.update("parent", {"w": "1"}), "table there already": lambda: db.create_table("parent", [Column("id", "int")]),
        "row hit twice": lambda: db.insert("parent", [(1, "x"), (1, "y")], conflict=Conflict({"v": "excluded.v"})),
    }
    rows = []
    for what, attempt in attempts.items():
        try:
            attempt()
            rows.append(("00000", what))
        except SqlError as e:
            rows.append((e.state, what))
        except Exception as e:  # raised by an expression in a job
            rows.append(("22001" if "22001" in str(e) else "XX000", what))
    assert sorted(map(tuple, db.table("parent").collect())) == [(1, "a"), (2, "b")]
    return spark.createDataFrame(rows, "state string, what string")


@query(
    """SELECT n_nationkey AS id, n_regionkey AS region, 'kept' AS what FROM nation WHERE n_regionkey NOT IN (1, 2)
       UNION ALL SELECT n_nationkey, 12, 'moved' FROM nation WHERE n_regionkey = 2
       UNION ALL SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE s_nationkey END, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def foreign_key_actions(spark: SparkSession, folder: str) -> DataFrame:
    """ON DELETE CASCADE then SET NULL below it, and ON UPDATE CASCADE."""
    db = _database(spark)
    db.create_table("region", [Column("id", "int"), Column("name", "text")], primary_key=["id"])
    db.create_table("nation", [Column("id", "int"), Column("region", "int")], primary_key=["id"], foreign_keys=[ForeignKey(["region"], "region", ["id"], "cascade", "cascade")])
    db.create_table("supplier", [Column("id", "bigint"), Column("nation", "int")], foreign_keys=[ForeignKey(["nation"], "nation", ["id"], "set null")])
    db.insert("region", load(spark, folder, "region").select("r_regionkey", "r_name"))
    db.insert("nation", load(spark, folder, "nation").select("n_nationkey", "n_regionkey"))
    db.insert("supplier", load(spark, folder, "supplier").select("s_suppkey", "s_nationkey"))
    db.delete("region", "id = 1")
    db.update("region", {"id": "id + 10"}, "id = 2")
    nations = db.table("nation").selectExpr("CAST(id AS BIGINT) AS id", "region", "CASE WHEN region = 12 THEN 'moved' ELSE 'kept' END AS what")
    return nations.unionAll(db.table("supplier").selectExpr("id", "nation", "'supplier'"))


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'late' ELSE 'old' END AS flag FROM nation")
def alter_table(spark: SparkSession, folder: str) -> DataFrame:
    """ADD COLUMN with a constant default, RENAME COLUMN, RENAME TO and ADD CONSTRAINT."""
    db = _database(spark)
    n = load(spark, folder, "nation")
    db.create_table("n", [Column("id", "int"), Column("name", "text")], primary_key=["id"])
    db.insert("n", n.filter("n_nationkey < 20").select("n_nationkey", "n_name"))
    db.add_column("n", Column("flag", "text", default="'old'"))
    db.rename_column("n", "id", "k")
    db.rename_table("n", "nations")
    db.insert("nations", n.filter("n_nationkey >= 20").selectExpr("n_nationkey", "n_name", "'late'"))
    db.add_constraint("nations", unique=["name"], check="flag IN ('old', 'late')")
    return db.table("nations")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey")
def create_table_as(spark: SparkSession, folder: str) -> DataFrame:
    db = _database(spark)
    db.create_table_as("counts", load(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")))
    return db.table("counts")


@query("SELECT n_nationkey + 1 AS id, 0 AS wrong FROM nation UNION ALL SELECT * FROM (VALUES (100, 0), (101, 0), (40, 0), (50, 0)) t")
def sequences_and_serial(spark: SparkSession, folder: str) -> DataFrame:
    db = _database(spark)
    db.create_table("t", [Column("id", "bigserial"), Column("name", "text")], primary_key=["id"])
    db.insert("t", load(spark, folder, "nation").select("n_name"), ["name"])
    db.setval("t_id_seq", 100, is_called=False)
    db.insert("t", [("x",), ("y",)], ["name"])
    db.create_sequence("s", 40, 10)
    seen = [db.nextval("s"), db.nextval("s")]
    assert db.currval("s") == seen[1]
    rows = db.table("t").selectExpr("id", "CAST(0 AS INT) AS wrong")
    return rows.unionAll(spark.createDataFrame([(v, 0) for v in seen], "id long, wrong int"))


@query("SELECT 'rolled back' AS step, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'snapshot', count(*) FROM customer UNION ALL SELECT 'after', count(*) - 10 FROM customer UNION ALL SELECT 'conflict 40001', 1")
def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Rollback, a repeatable snapshot beside another writer, and the first updater winning."""
    db = _customers(spark, folder)
    other = Database(spark, db.root)
    db.begin()
    db.delete("customers", "id > 5")
    db.rollback()
    steps = [("rolled back", db.table("customers").count())]
    db.begin("repeatable read")
    first = db.table("customers").count()
    other.delete("customers", "id < 10")
    assert first == db.table("customers").count()
    steps.append(("snapshot", db.table("customers").count()))
    db.update("customers", {"balance": "0"}, "id = 100")
    try:
        db.commit()
        steps.append(("lost update", 1))
    except SqlError as e:
        steps.append((f"conflict {e.state}", 1))
    steps.append(("after", db.table("customers").count()))
    return spark.createDataFrame(steps, "step string, n long")


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey = 4")
def create_index_clusters(spark: SparkSession, folder: str) -> DataFrame:
    db = _customers(spark, folder)
    db.create_index("by_nation", "customers", ["nation", "id"])
    return db.table("customers").filter("nation = 4").select("id", "nation")


@query("SELECT 'nation' AS t, CAST(0 AS BIGINT) AS n, false AS still UNION ALL SELECT 'region', count(*), true FROM region")
def truncate_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    db = _database(spark)
    for name in ("nation", "region"):
        db.create_table_as(name, load(spark, folder, name))
    db.truncate("nation")
    emptied = db.table("nation").count()
    kept = db.table("region").count()
    db.drop_table("nation")
    db.drop_table("nation", if_exists=True)
    db.vacuum()
    return spark.createDataFrame([("nation", emptied, "nation" in db.tables()), ("region", kept, "region" in db.tables())], "t string, n long, still boolean")


def _statistics(column: str, sql: str) -> str:
    return f"SELECT '{column}' AS column_name, CAST(count(*) - count({sql}) AS DOUBLE) / count(*) AS null_frac, count(DISTINCT {sql}) AS n_distinct, CAST(least(10, count(DISTINCT {sql})) AS INTEGER) AS common FROM customer"


@query(" UNION ALL ".join(_statistics(*c) for c in (("id", "c_custkey"), ("name", "c_name"), ("nation", "c_nationkey"), ("balance", "CAST(c_acctbal AS DECIMAL(12,2))"))))
def analyze_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per column: share of nulls, distinct values and how many common values were kept."""
    db = _customers(spark, folder)
    rows = [(s["column"], float(s["null_frac"]), int(s["n_distinct"]), len(s["common"])) for s in db.analyze("customers")]
    return spark.createDataFrame(rows, "column_name string, null_frac double, n_distinct long, common int")
