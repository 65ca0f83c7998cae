"""Stage tables: each stage's rows are kept, and only sources without them are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Parquet tables below a path, one for each stage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else None

    def unfinished(self, name: str, sources: DataFrame, keys: list[str]) -> DataFrame:
        done = self.read(name)
        return sources if done is None else sources.join(done.select(*keys).distinct(), keys, "left_anti")

    def run(self, name: str, sources: DataFrame, keys: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All rows of a stage; only sources that it has no rows of are computed, and added."""
        todo = self.unfinished(name, sources, keys)
        if self.read(name) is None or not todo.isEmpty():
            stage(todo).write.mode("append").parquet(f"{self.path}/{name}")
        return self.read(name)

    def clear(self, name: str, folder: bool = False) -> int:
        """Delete what a stage's folder holds, and with ``folder`` the folder; how many entries that were."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return 0
        held = [s.getPath() for s in fs.listStatus(at)]
        for path in held:
            fs.delete(path, True)
        if folder:
            fs.delete(at, True)
        return len(held)


def mismatched(hierarchy_leaves: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Sources whose stored payloads are not as many as their content nodes, or that have none."""
    a = hierarchy_leaves.groupBy(*keys).agg(F.count_if("is_content").alias("leaves"))
    b = payloads.groupBy(*keys).agg(F.count(F.lit(1)).alias("payloads"))
    both = a.join(b, keys, "left").withColumn("payloads", F.coalesce("payloads", F.lit(0)))
    return both.withColumn("problem", F.when(F.col("leaves") == 0, "no content nodes").when(F.col("leaves") != F.col("payloads"), "count mismatch")).where("problem is not null")
