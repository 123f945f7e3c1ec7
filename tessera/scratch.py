"""Paths for tables that a query writes for itself, in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset: a temporary one in
    local mode, and a folder of the warehouse, which a cluster shares, otherwise."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="tessera-")
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has gone: the folder's owner clears it
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path, removed when the driver ends."""
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}-{label}"
    atexit.register(_remove_quietly, spark, path)
    return path
