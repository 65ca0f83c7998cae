"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

#: ASCII white space, the only separators of words here.
SPACE = r"[\x20\x09-\x0D]+"
CACHE_ENTRIES = 400_000
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


scratch_dir = scratch.folder  # the shared folder named by spark.checkpoint.dir


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: what depends on it survives lost executors without
    recomputing the Python work above it, and repeated uses read the same rows.
    """
    spark = spark or df.sparkSession
    path = f"{scratch_dir(spark)}/notes/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more; what was not stored stays."""
    paths = {getattr(t, "stored_at", None) for t in tables} - {None}
    for spark, path in [x for x in _written if x[1] in paths]:
        _written.remove((spark, path))
        _delete(spark, path)


def drop_stored(spark: SparkSession | None = None) -> int:
    """Delete all that a session (or any) has stored, once its results are written; how many tables that were."""
    mine = [x for x in _written if spark is None or x[0] is spark]
    for x in mine:
        _written.remove(x)
        _delete(*x)
    return len(mine)


@atexit.register
def _at_exit() -> None:
    if SparkContext._active_spark_context is not None:  # else the session is gone, and the folder's owner clears it
        drop_stored()


def others(df: DataFrame, *names: str) -> list[Column]:
    """Columns of a table but those of these names, which an operator is to write (Spark does not look at case)."""
    taken = {n.lower() for n in names}
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns if c.lower() not in taken]


SAMPLED = 1 << 30  # steps of a share that rows are sampled by


def sampled(df: DataFrame, key: Column, most: int, rows: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df``, those with the least hashes of ``key``; all if there are no more.

    A threshold on the hash, so nothing is sorted, and what is not chosen goes no
    further than its scan.
    """
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(SAMPLED)) < int(SAMPLED * (most / rows)))


SIEVE_BITS = 1 << 23  # 1 MB, whatever it is made of


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(SIEVE_BITS))


def sieve(keys: DataFrame, key: Column) -> Column:
    """A bitmap of fixed size of all hashes ``key`` (long) of a table, as a scalar subquery.

    With ``may_hold`` it lets a scan tell most rows that a table does not hold
    from those that it may hold, so that only these go on to the exact join.
    Where the table is very large, the bitmap is full and all rows go on.
    """
    words = SIEVE_BITS // 64
    at = _place(key)
    some = keys.where(key.isNotNull()).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits"))
    full = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(some, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return full.agg(F.transform(ordered, lambda x: x["bits"]).alias("sieve")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """Whether the table of a sieve may hold the hash; a null hash may always be there."""
    at = _place(key)
    return F.coalesce(F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1, F.lit(True))


def fold(col: str, mod: int) -> Column:
    """crc32 of an id as text, modulo ``mod`` (a null id falls in fold -1)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(-1)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def whole_texts(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose batches for Python are bounded to 8 MB, unless it has a bound of its own."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        conf.set(BATCH_BYTES, str(8 << 20))
    return docs


def give_back() -> None:
    """Give the memory that a Python worker has freed back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidied(run):
    """A function over batches that gives the memory it has freed back to the system when its task ends.

    Python workers live on from task to task, and stages of other kinds follow.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def byte_bounded(batches: Iterator[pa.RecordBatch], column: str | tuple[str, str], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column) if isinstance(column, str) else batch.column(column[0]).field(column[1])
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


import pyarrow.compute  # noqa: E402  (pa.compute is a module of its own)
