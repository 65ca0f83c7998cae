"""Which branch a source takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
READY = ["youtube", "article", "markdown"]
PLANNED = ["documentation", "book", "presentation"]


def context_problem(total: Column, current: Column, parts: Column) -> Column:
    """Why a processing context is not valid, or null; the first that applies.  ``parts`` is the number of parts there are."""
    return (
        F.when(total <= 0, "total")
        .when(parts <= 0, "no parts")
        .when(current < 1, "current")
        .when(current > total, "beyond total")
        .when(current > parts, "beyond parts")
    )


def after_mode(mode: Column) -> Column:
    return F.when(mode == "multi_part", "select_transcript_breakpoints").otherwise("advance_transcript_part")


def after_breakpoints(total_parts: Column) -> Column:
    return F.when(total_parts <= 0, "invalid_transcript_breakdown").otherwise("advance_transcript_part")


def after_part(mode: Column, current: Column, total: Column) -> Column:
    return F.when((mode == "single") | (current > total), "render_markdown").otherwise("advance_transcript_part")


def after_advance(source_type: Column) -> Column:
    return F.when(source_type == "youtube", "clean_transcript").when(source_type == "article", "clean_article")


def after_validation(content_nodes: Column) -> Column:
    return F.when(content_nodes > 0, "extract_content_nodes").otherwise("hierarchy_validation_failed")


def ended(sources: DataFrame) -> DataFrame:
    """Sources that end without notes, with pipeline_complete and error_message (source columns, content_nodes, total_parts, error).

    A source whose parts are too large (total_parts 0 or less) ends before one without content nodes; nulls have not got that far.
    """
    broken, empty = F.coalesce(F.col("total_parts") <= 0, F.lit(False)), F.coalesce(F.col("content_nodes") <= 0, F.lit(False))
    message = F.when(broken, F.coalesce(F.nullif("error", F.lit("")), F.lit("parts too large"))).otherwise("no content nodes")
    return sources.where(broken | empty).withColumns({"pipeline_complete": F.lit(False), "error_message": message})


def routed(sources: DataFrame, base: str) -> DataFrame:
    """Sources with branch (a ready type, unsupported or rejected), base_dir and problem."""
    kind = F.lower(F.trim("source_type"))
    empty = F.coalesce(F.trim("source"), F.lit("")) == ""
    known = F.coalesce(kind.isin(READY + PLANNED), F.lit(False))
    branch = F.when(~known | empty, "rejected").when(kind.isin(PLANNED), "unsupported").otherwise(kind)
    problem = F.when(~known, "unknown source type").when(empty, "empty source").when(kind.isin(PLANNED), "not implemented")
    return sources.withColumns({"branch": branch, "base_dir": F.when(known & ~empty, F.concat_ws("/", F.lit(base), kind)), "problem": problem})
