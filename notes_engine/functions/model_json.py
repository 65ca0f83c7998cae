"""What model answers and user answers hold, as column functions over JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_positive(*values: Column) -> Column:
    """The first value that is neither null nor 0."""
    out = F.lit(None).cast("long")
    for v in reversed(values):
        out = F.when(F.coalesce(v.cast("long"), F.lit(0)) != 0, v.cast("long")).otherwise(out)
    return out


def token_usage(response: Column) -> Column:
    """Struct (input, output, total) of a response: usage metadata of its messages, then token_usage, then usage."""
    at = lambda p: F.get_json_object(response, p).try_cast("long")
    messages = F.from_json(F.get_json_object(response, "$.generations"), "array<struct<usage_metadata: struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>>>")
    added = lambda k: F.aggregate(F.coalesce(messages, F.array().cast("array<struct<usage_metadata: struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>>>")), F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m["usage_metadata"][k], F.lit(0)))
    return F.struct(
        first_positive(added("input_tokens"), at("$.llm_output.token_usage.prompt_tokens"), at("$.llm_output.usage.input_tokens")).alias("input_tokens"),
        first_positive(added("output_tokens"), at("$.llm_output.token_usage.completion_tokens"), at("$.llm_output.usage.output_tokens")).alias("output_tokens"),
        first_positive(added("total_tokens"), at("$.llm_output.token_usage.total_tokens"), at("$.llm_output.usage.total_tokens")).alias("total_tokens"),
    )


def items(response: Column, field: str) -> Column:
    """Array of (id, text) of a structured answer; null if it is not one."""
    parsed = F.from_json(response, f"struct<items: array<struct<id: string, {field}: string>>>")["items"]
    good = F.forall(parsed, lambda x: x["id"].isNotNull() & x[field].isNotNull())
    return F.when(good, F.transform(parsed, lambda x: F.struct(x["id"].alias("id"), x[field].alias("text"))))


def selection(answer: Column) -> Column:
    """Sorted distinct numbers of an answer such as "3, 7,12"; null where one is no number."""
    parts = F.transform(F.filter(F.split(answer, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_sort(F.array_distinct(parts)))


def resumed_selection(payload: Column) -> Column:
    """Indices of a resume payload, an object with selected_indices; null if it has another shape."""
    return F.from_json(payload, "struct<selected_indices: array<int>>")["selected_indices"]


# What the user is told when asked for the chapters at which parts start.
INSTRUCTIONS = [
    "Each selected chapter starts a NEW transcript part.", "Chapter 0 is automatically included.", "Do NOT select chapter 0.", "Selections must be in ascending order.",
    "Example:", '{"selected_indices": [4, 8, 15]}',
]


def question(chapters: Column, tokens: Column, limit: int) -> Column:
    """What the user is asked when a source is too long: JSON with a summary, menu rows of its chapters, and instructions."""
    summary = F.struct(F.size(chapters).alias("total_chapters"), tokens.alias("total_tokens"), F.lit(limit).alias("max_tokens_per_part"))
    return F.to_json(F.struct(F.lit("chapter_selection").alias("type"), summary.alias("summary"), chapters.alias("chapters"), F.array(*map(F.lit, INSTRUCTIONS)).alias("instructions")))
