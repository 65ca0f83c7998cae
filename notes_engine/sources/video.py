"""Videos: chapters from descriptions or info records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import ascending


def description_chapters(df: DataFrame, key: str, description: str) -> DataFrame:
    """key, chapter_idx, title, timestamp_seconds, display from lines with a time; only times that grow count."""
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(T.unix_newlines(F.col(description)), "\n")).alias("pos", "line"))
    stamp = lambda k: F.regexp_extract("line", T.TIMESTAMP, k)
    hit = lines.where(F.col("line").rlike(T.TIMESTAMP)).withColumn("timestamp_seconds", T.stamp_seconds(stamp(1), stamp(2), stamp(3))).where("timestamp_seconds is not null")
    rest = F.regexp_replace(F.regexp_replace("line", T.TIMESTAMP, ""), r"^[\s\-–—|•]+|[\s\-–—|•]+$", "")
    display = T.hms(F.col("timestamp_seconds"))
    kept = ascending(hit.withColumn("display", display).withColumn("title", F.coalesce(F.nullif(rest, F.lit("")), display)), [key], ["pos"], "timestamp_seconds")
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).alias("chapter_idx"), "title", "timestamp_seconds", "display")


def info_chapters(info: Column) -> Column:
    """Array of (title, timestamp_seconds, display) from an info record's chapters; entries without a time or a title are skipped, blank titles are not."""
    found = F.from_json(info, "struct<chapters: array<struct<title: string, start_time: string>>>")["chapters"]
    seconds = lambda c: c["start_time"].try_cast("double").cast("int")
    parsed = F.transform(found, lambda c: F.struct(T.strip(c["title"]).alias("title"), seconds(c).alias("timestamp_seconds"), T.hms(seconds(c)).alias("display")))
    return F.coalesce(F.filter(parsed, lambda c: c["timestamp_seconds"].isNotNull() & c["title"].isNotNull()), F.array().cast("array<struct<title: string, timestamp_seconds: int, display: string>>"))


def chapters(df: DataFrame, key: str, info: str, description: str) -> DataFrame:
    """key, chapter_idx, title, timestamp_seconds, display: those of the info record, or where it has none those of the description."""
    native = df.select(key, info_chapters(F.col(info)).alias("c"))
    own = native.select(key, F.posexplode("c").alias("chapter_idx", "c")).select(key, "chapter_idx", "c.title", "c.timestamp_seconds", "c.display")
    return own.unionByName(description_chapters(df.where(F.size(info_chapters(F.col(info))) == 0), key, description))


def mode(chapters: DataFrame, key: str, limit: int) -> DataFrame:
    """key, tokens, mode: single if all chapters fit, else multi_part."""
    total = chapters.groupBy(key).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
    return total.withColumn("mode", F.when(F.col("tokens") <= limit, "single").otherwise("multi_part"))


def spoken(snippets: DataFrame, key: str) -> DataFrame:
    """key, valid: whether any snippet has a visible character."""
    return snippets.groupBy(key).agg(F.coalesce(F.bool_or(F.col("text").rlike(r"\S")), F.lit(False)).alias("valid"))
