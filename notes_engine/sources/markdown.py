"""Markdown files: metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Lines that name an author or a date, in order of preference.
AUTHOR = [r"(?i)^\*\*Author:\*\*\s*(.+)$", r"(?i)^Author:\s*(.+)$", r"(?i)^By\s+(.+)$"]
DATE = [r"(?i)^\*\*Date:\*\*\s*(.+)$", r"(?i)^Date:\s*(.+)$", r"(?i)^Published:\s*(.+)$", r"(?i)^Published on:\s*(.+)$", r"(?i)^Last updated:\s*(.+)$", r"(?i)^Updated:\s*(.+)$"]


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, raw_content of the files below a path; blank ones are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_content")).where(F.col("raw_content").rlike(r"\S"))


def checked(spark: SparkSession, root: str, sources: DataFrame) -> DataFrame:
    """path, raw_content, problem of sources (a column path, below ``root``): missing, suffix (not .md, in any case) or empty; the first that applies.

    A folder counts as missing.  Content is null where there is a problem.
    """
    there = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("raw_content"))
    base = root.removeprefix("file:").rstrip("/").lstrip("/")
    files = there.select(F.regexp_replace(F.substring_index("file", base, -1), "^/+", "").alias("_path"), "raw_content", F.lit(True).alias("_there"))
    own = F.regexp_replace("path", r"^(?:\./)+", "")
    both = sources.select("path").distinct().withColumn("_path", own).join(files, "_path", "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(~F.lower("path").endswith(".md"), "suffix").when(~F.col("raw_content").rlike(r"\S"), "empty")
    return both.select("path", F.when(problem.isNull(), F.col("raw_content")).alias("raw_content"), problem.alias("problem"))


def title(raw: Column, source: Column) -> Column:
    """First heading of level one, else the stem of the source, else Untitled."""
    stem = F.regexp_extract(source, r"([^/\\]+?)(?:\.[A-Za-z0-9]+)?/*$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"(?m)^\s*#\s+(.+?)\s*$", 1), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Untitled"))


def description(raw: Column) -> Column:
    """First paragraph that is no heading, quote, markup, code or list; 500 characters at most."""
    blocks = F.transform(F.split(T.unix_newlines(raw), r"\n\s*\n"), T.strip)
    good = F.filter(blocks, lambda p: (p != "") & ~p.rlike(r"^(#|>|<|```|- |\* )"))
    return F.substring(T.squeeze(F.coalesce(F.get(good, F.lit(0)), F.lit(""))), 1, 500)


def first_line(raw: Column, patterns: list[str]) -> Column:
    """What the first line that fits has, by the first pattern that fits it; empty if none does."""
    lines = F.transform(F.split(T.unix_newlines(raw), "[\n\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"), T.strip)
    found = F.transform(lines, lambda x: F.coalesce(*[F.nullif(T.strip(F.regexp_extract(x, p, 1)), F.lit("")) for p in patterns]))
    return F.coalesce(F.get(F.array_compact(found), F.lit(0)), F.lit(""))


def metadata(files: DataFrame) -> DataFrame:
    """content_id, path, title, description, author, upload_date of files (path, raw_content)."""
    t = title(F.col("raw_content"), F.col("path"))
    return files.select(F.sha2(F.concat_ws("::", T.strip(F.col("path")), T.strip(t)), 256).alias("content_id"), "path", t.alias("title"), description(F.col("raw_content")).alias("description"),
                        first_line(F.col("raw_content"), AUTHOR).alias("author"), first_line(F.col("raw_content"), DATE).alias("upload_date"))
