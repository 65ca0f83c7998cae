"""Arrival of sources as a file stream, and windows over the progress log.

Additions to the batch engine: state of each source lies in stage tables, so a
restarted stream goes on where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def process_available(sources: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Run ``batch`` over all sources that have arrived since the last call."""
    sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def per_window(progress: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and status; rows later than the watermark are dropped by a stream."""
    p = progress.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return p.groupBy(F.window("ts", length), "status").agg(F.count(F.lit(1)).alias("events"))


def sessions(progress: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    p = progress.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return p.groupBy(F.session_window("ts", gap), "node_name").agg(F.count(F.lit(1)).alias("events"))
