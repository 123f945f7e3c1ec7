"""Structured Streaming over the tables' files, an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(spark: SparkSession, path: str, width: str, out: str, late: str = "10 minutes") -> DataFrame:
    """Counts of event types by tumbling window of ``ts``, of all rows that are there now.

    The stream's state is kept under ``out``/state and its result under
    ``out``/rows, so a stopped query goes on where it was.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    counts = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        """A batch's changed windows replace the earlier ones: the last version of a window counts."""
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.lit(number).alias("_batch")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(f"{out}/rows")
    return done.groupBy("hour", "event_type").agg(F.max_by("n", "_batch").alias("n"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
