"""Text and JSON files of single sources, read as tables and written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "map<string, struct<content: string, summary: string>>"


def read_text(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, value: one row for each file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path, doc: JSON of any shape; null where a file is not valid."""
    return read_text(spark, path, "*.json").select("path", F.try_parse_json("value").alias("doc"))


def store_rows(df: DataFrame, keys: list[str], store: str) -> DataFrame:
    """keys, node_id, content, summary of a content store in JSON; absent texts are empty."""
    items = df.select(*keys, F.explode(F.from_json(store, STORE)).alias("node_id", "item"))
    return items.select(*keys, "node_id", F.coalesce("item.content", F.lit("")).alias("content"), F.coalesce("item.summary", F.lit("")).alias("summary"))


def store_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, store: the content store of each source as JSON."""
    entry = F.struct("node_id", F.struct("content", "summary").alias("item"))
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("store"))


def export(df: DataFrame, path: str, name: str, text: str) -> None:
    """A directory ``name=...`` for each source with its text; as many files at once as there are tasks."""
    df.select(F.col(name), F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


def chunk_name(part: Column, chunk: Column) -> Column:
    return F.format_string("cleaned_content_part_%03d_%03d.txt", part, chunk)
