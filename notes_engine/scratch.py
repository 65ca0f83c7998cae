"""Tables that are written to the shared folder and read back, so that what made them runs once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # folders of local sessions, by application
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the one machine of a local master, and an error on a cluster.

    The session's settings stay as they are.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='notes-scratch-')}"
        where = _local[app]
    return where.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: for answers of models and other rows that must not differ between two uses.

    The table lasts until ``release``, ``drop_kept`` or the end of the program.
    """
    path = f"{folder(df.sparkSession)}/notes/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more; what was not kept stays."""
    paths = {getattr(t, "stored_at", None) for t in tables} - {None}
    for x in [x for x in _written if x[1] in paths]:
        _written.remove(x)
        _delete(*x)


def drop_kept(spark: SparkSession | None = None) -> int:
    """Delete all that a session (or any) has kept, once its results are written; how many tables that were."""
    mine = [x for x in _written if spark is None or x[0] is spark]
    for x in mine:
        _written.remove(x)
        _delete(*x)
    return len(mine)


@atexit.register
def _at_exit() -> None:
    if SparkContext._active_spark_context is not None:  # else the session is gone, and the folder's owner clears it
        drop_kept()
