"""Parquet tables of a data folder, lazily and with pruned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Schemas by path and time of change, so that a table is not opened anew for each query.
_schemas: dict[tuple[str, int], StructType] = {}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    key = path.toString(), path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(key[0]).schema
    return spark.read.schema(_schemas[key]).parquet(key[0])


def register_views(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of the folder's tables, all by default."""
    for name in names or TABLES:
        load(spark, folder, name).createOrReplaceTempView(name)


def clustered(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Write ``df`` in the order of ``keys``, what an ordered index is for here: files
    and row groups outside a key range are skipped by their statistics."""
    parts = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    parts.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
