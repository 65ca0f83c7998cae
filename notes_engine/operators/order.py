"""Order-dependent operators as windows over one partitioning of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _before(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def numbered_points(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, point_no, point: bullets with the lines that follow them, numbered from 1.

    Blank lines and separators are skipped.  Text before the first bullet is a
    point.  An empty bullet is a point, unless it is the last.
    """
    lines = df.select(*keys, F.posexplode(F.split(T.unix_newlines(F.col(text)), "\n")).alias("pos", "raw")).withColumn("line", T.rstrip("raw"))
    lines = lines.where((F.trim("line") != "") & ~T.is_separator(F.col("line")))
    lines = lines.withColumn("bullet", T.is_bullet(F.col("line"))).withColumn("piece", T.strip(F.when(F.col("bullet"), T.bullet_text(F.col("line"))).otherwise(F.col("line"))))
    lines = lines.withColumn("grp", F.sum(F.col("bullet").cast("int")).over(_so_far(keys, "pos")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("pos", "piece"))))
    points = lines.groupBy(*keys, "grp").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("joined"))
    points = points.withColumn("point", T.strip(T.one_blank(F.col("joined")))).withColumn("last", F.max("grp").over(Window.partitionBy(*keys)))
    points = points.where(~((F.col("grp") == F.col("last")) & (F.col("point") == "")))
    return points.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("grp")).alias("point_no"), "point")


def read_points(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, point_no, point, valid: lines ``N. text``; valid if a source's numbers are exactly 1 to N."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\d+\.\s+.*$"))
    lines = lines.select(*keys, "pos", F.regexp_extract("line", r"^\s*(\d+)\.\s+(.*)$", 1).cast("int").alias("point_no"), F.regexp_extract("line", r"^\s*(\d+)\.\s+(.*)$", 2).alias("point"))
    by = Window.partitionBy(*keys)
    right = F.row_number().over(by.orderBy("pos")) == F.col("point_no")
    return lines.withColumn("right", right).select(*keys, "point_no", "point", F.bool_and("right").over(by).alias("valid"))


def equal_weight(df: DataFrame, keys: list[str], order: list[str], weight: str, parts: int | Column, out: str = "batch") -> DataFrame:
    """Contiguous parts of near-equal weight: 1 to ``parts`` (a number, or a column that is the same in all rows of a source), some perhaps empty."""
    w, parts = F.col(weight).cast("long"), parts.cast("long") if isinstance(parts, Column) else F.lit(parts).cast("long")
    before, total = F.coalesce(F.sum(w).over(_before(keys, *order)), F.lit(0)), F.sum(w).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(total == 0, parts).otherwise(F.least(parts, F.call_function("div", before * parts, F.nullif(total, F.lit(0))) + 1)).cast("int"))


def fill_gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", tie: str = "node_pos") -> DataFrame:
    """Ranges whose start is moved back to the end of what came before; overlaps stay."""
    reach = F.coalesce(F.max(end).over(_before(keys, start, end, tie)), F.lit(0))
    return df.withColumn("filled", F.least(F.col(start), reach + 1))


def ranges_of(df: DataFrame, keys: list[str], last: str = "last") -> DataFrame:
    """(first, last) ranges between boundaries."""
    return df.withColumn("first", F.coalesce(F.lag(last).over(Window.partitionBy(*keys).orderBy(last)), F.lit(0)) + 1)


def last_points(points: DataFrame, keys: list[str], parts: int, point: str = "point") -> DataFrame:
    """keys, part, last: the last point that starts within each equal share of the characters; the last of all for the last part."""
    by = Window.partitionBy(*keys)
    size = F.length(F.concat(F.col("point_no").cast("string"), F.lit(". "), F.col(point)))
    at = points.withColumn("size", size + 1).withColumn("reach", F.sum("size").over(_so_far(keys, "point_no")) - 1)
    at = at.withColumn("total", F.max("reach").over(by)).withColumn("n", F.max("point_no").over(by)).withColumn("begin", F.col("reach") - F.col("size") + 1)
    each = at.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    within = F.col("begin") <= F.ceil(F.col("total") * F.col("part") / parts)
    return each.groupBy(*keys, "part").agg(F.max(F.when(within, F.col("point_no"))).alias("hit"), F.max("n").alias("n")).select(
        *keys, "part", F.when(F.col("part") == parts, F.col("n")).otherwise(F.coalesce("hit", F.lit(1))).alias("last"))


def ascending(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is above all before it."""
    return df.withColumn("_top", F.coalesce(F.max(value).over(_before(keys, *order)), F.lit(-1))).where(F.col(value) > F.col("_top")).drop("_top")


def segments(chapters: DataFrame, snippets: DataFrame, key: str) -> DataFrame:
    """key, chapter_idx, title, transcript: snippets under the last chapter at or before their start.

    A union and two running maxima; no range join.  Snippets before the first
    chapter belong to it; a snippet never goes back to an earlier chapter.
    Chapters after the last one reached are dropped, passed-over ones are empty.
    """
    c = chapters.select(key, F.lit(0).alias("kind"), F.col("timestamp_seconds").cast("double").alias("at"), "chapter_idx", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"))
    s = snippets.select(key, F.lit(1).alias("kind"), F.col("start").cast("double").alias("at"), F.lit(None).cast("int").alias("chapter_idx"), F.col("pos").cast("long").alias("pos"), "text")
    both = c.unionByName(s).withColumn("hit", F.coalesce(F.max("chapter_idx").over(_so_far([key], "at", "kind", "chapter_idx", "pos")), F.lit(0)))
    hits = both.where("kind = 1").withColumn("chapter_idx", F.max("hit").over(_so_far([key], "pos")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = hits.groupBy(key, "chapter_idx").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("transcript"))
    reached = hits.groupBy(key).agg(F.max("chapter_idx").alias("reached"))
    named = chapters.select(key, "chapter_idx", "title").join(reached, key).where("chapter_idx <= reached")
    return named.join(grouped, [key, "chapter_idx"], "left").select(key, "chapter_idx", "title", F.coalesce("transcript", F.lit("")).alias("transcript"))


def chapter_groups(chapters: DataFrame, key: str, breaks: str) -> DataFrame:
    """Chapters with the number of their part; a part starts at each index in the array ``breaks``."""
    starts = F.array_contains(breaks, F.col("chapter_idx")).cast("int")
    return chapters.withColumn("part_idx", F.coalesce(F.sum(starts).over(_so_far([key], "chapter_idx")), F.lit(0)).cast("int"))


def content_parts(chapters: DataFrame, key: str, limit: int) -> DataFrame:
    """key, part_idx, part_title, content, tokens, too_large of grouped chapters."""
    ordered = F.array_sort(F.collect_list(F.struct("chapter_idx", "transcript")))
    parts = chapters.groupBy(key, "part_idx").agg(
        F.min_by("display", "chapter_idx").alias("first"), F.array_join(F.transform(ordered, lambda x: x["transcript"]), "\n\n").alias("content"), F.sum("tokens").alias("tokens"))
    upto = F.coalesce(F.lead("first").over(Window.partitionBy(key).orderBy("part_idx")), F.lit("END"))
    title = F.concat(T.file_stamp(F.col("first")), F.lit("_"), F.when(upto == "END", upto).otherwise(T.file_stamp(upto)))
    return parts.select(key, "part_idx", title.alias("part_title"), "content", "tokens", (F.col("tokens") > limit).alias("too_large"))


def breaks_problem(selected: Column, highest: Column) -> Column:
    """Why an array of break points is not valid, or null: not unique, not ascending, or out of 1 to highest."""
    return (
        F.when(F.size(selected) == 0, None)
        .when(F.size(F.array_distinct(selected)) != F.size(selected), "duplicate")
        .when(F.array_sort(selected) != selected, "order")
        .when(~F.forall(selected, lambda x: (x >= 1) & (x <= highest)), "range")
    )


def chunks(df: DataFrame, keys: list[str], text: str, n: str, overlap: int = 500) -> DataFrame:
    """keys, chunk, content: ``n`` pieces of equal size, each with ``overlap`` characters of the one before."""
    size = F.length(text)
    count = F.greatest(F.least(F.col(n).cast("int"), size), F.lit(1))
    step = F.ceil(size / F.col("_n")).cast("int")
    each = df.where(size > 0).withColumn("_n", count).withColumn("_step", step).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.greatest(F.lit(0), F.col("chunk") * F.col("_step") - overlap)
    end = F.least(F.length(text), (F.col("chunk") + 1) * F.col("_step"))
    return each.withColumn("content", F.when(end > start, F.substring(text, start + 1, end - start)).otherwise("")).where("content != ''").select(*keys, "chunk", "content")
