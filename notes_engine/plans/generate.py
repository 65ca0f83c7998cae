"""Structured content and summaries by a model function, in batches, with validation, retries and a second partition.

A source's payloads are cut in batches of near-equal weight.  A batch whose answer
repeats an id or has a wrong one is asked again, as is one whose call failed for
a passing reason; an answer with a wrong number of items is not.  A source with
such an answer starts again in the batches that the fallback budget allows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching
from ..scratch import kept
from . import models

# Tokens that the metadata of one payload is taken to need.
CONTENT_OVERHEAD, SUMMARY_OVERHEAD = 60, 50
CONTENT_BUDGET, CONTENT_FALLBACK = 8000, 6000
SUMMARY_BUDGET, SUMMARY_FALLBACK = 5000, 4000


def problem_of(items: list[dict] | None, field: str, n: int) -> str | None:
    """Why the items answered to a batch of N1 to Nn are not right: form, count, duplicate or incorrect_ids; the first that applies."""
    if not isinstance(items, list) or not all(isinstance(x, dict) and isinstance(x.get("id"), str) and isinstance(x.get(field), str) for x in items):
        return "form"
    ids = [x["id"] for x in items]
    if len(ids) != n:
        return "count"
    if len(set(ids)) != len(ids):
        return "duplicate"
    return "incorrect_ids" if set(ids) != {f"N{i}" for i in range(1, n + 1)} else None


def answered(batches: DataFrame, keys: list[str], field: str, provider: str, which: str = "", retries: int = 1) -> DataFrame:
    """keys, batch_id, status, attempts, items, duration_ms and input_tokens of every batch (keys, batch_id, input, n)."""
    make = models.factory(provider)
    fields = ", ".join(f"`{k}` {batches.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, batch_id string, status string, attempts int, items array<struct<id: string, text: string>>, duration_ms double, input_tokens long"

    def one(ask, prompt: str, n: int) -> tuple[str, int, list]:
        for attempt in range(1, max(1, retries) + 1):
            try:
                items = json.loads(ask(prompt)).get("items")
                status, again = problem_of(items, field, n) or "ok", False
            except Exception as e:  # the status says what went wrong
                items, status, again = None, f"call: {type(e).__name__}", getattr(e, "is_transient", False)
            if status == "ok":
                return status, attempt, [{"id": x["id"], "text": x[field]} for x in items]
            if status not in batching.RETRYABLE and not again:
                return status, attempt, []
        return f"exhausted: {status}", attempt, []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make(which)
        for f in frames:
            got, took = [], []
            for p, n in zip(f["input"], f["n"], strict=True):
                began = time.monotonic_ns()
                got.append(one(ask, p, int(n)))
                took.append(round((time.monotonic_ns() - began) / 1e6, 2))
            out = f[[*keys, "batch_id"]].copy()
            out["status"], out["attempts"], out["items"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            out["duration_ms"], out["input_tokens"] = took, f["input_tokens"]
            yield out

    return batches.select(*keys, "batch_id", "input", "n", T.token_estimate(F.col("input")).alias("input_tokens")).mapInPandas(run, schema)


def records(answers: DataFrame, keys: list[str], node: str, operation: str, provider: str, which: str = "") -> DataFrame:
    """A record of each batch that was answered, as ``usage`` reads it; a failed one has the kind of its failure."""
    written = T.token_estimate(F.array_join(F.transform("items", lambda x: x["text"]), "\n"))
    good = F.col("status") == "ok"
    return models.record(answers.select(*keys, "input_tokens", written.alias("output_tokens"), "duration_ms", good.alias("success"), F.when(~good, F.col("status")).alias("exception_type")), node, operation, provider, which)


def ladder(payloads: DataFrame, keys: list[str], fields: list, weight: str, field: str, provider: str, which: str = "", retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """(keys, node_id, text) of sources that succeeded, and (keys, status, problem) of all sources.

    ``payloads``: keys, ord, node_id, what ``fields`` read, ``weight``, and the
    numbers of batches ``first_parts`` and ``fallback_parts``, the same in all
    rows of a source.  The status is ok, fallback or failed.
    """

    named = [*keys, "batch_no"]

    def run(rows: DataFrame, parts: str) -> tuple[DataFrame, DataFrame]:
        cut = batching.batches(rows, keys, weight, F.col(parts))
        asked = batching.batch_input(cut, *fields, keys=named)
        return cut, kept(answered(asked, named, field, provider, which, retries), "answers")

    def states(answers: DataFrame) -> DataFrame:
        """The first batch that is not ok decides on its source."""
        return answers.groupBy(*keys).agg(F.min_by("status", F.when(F.col("status") != "ok", F.col("batch_no"))).alias("problem"))

    def texts(cut: DataFrame, answers: DataFrame, good: DataFrame) -> DataFrame:
        items = answers.join(good, keys, "left_semi").select("batch_id", F.explode("items").alias("i")).select("batch_id", F.col("i.id").alias("temp_id"), F.col("i.text").alias("text"))
        return batching.restored(cut.join(good, keys, "left_semi").select(*keys, "batch_id", "temp_id", "node_id"), items).select(*keys, "node_id", "text")

    cut, first = run(payloads, "first_parts")
    state = states(first)
    again, second = run(payloads.join(state.where("problem = 'count'"), keys, "left_semi"), "fallback_parts")
    state2 = states(second)
    right = F.lit(None).cast("string").alias("problem")
    told = [
        state.where("problem is null").select(*keys, F.lit("ok").alias("status"), right),
        state.where("problem != 'count'").select(*keys, F.lit("failed").alias("status"), "problem"),
        state2.where("problem is null").select(*keys, F.lit("fallback").alias("status"), right),
        state2.where("problem is not null").select(*keys, F.lit("failed").alias("status"), F.concat(F.lit("even with fallback batches: "), F.col("problem")).alias("problem")),
    ]
    out = texts(cut, first, state.where("problem is null")).unionByName(texts(again, second, state2.where("problem is null")))
    out.answers = first.unionByName(second)  # for ``records``
    return out, told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


def with_parts(payloads: DataFrame, keys: list[str], text: Column, overhead: int, budget: int, fallback: int, tokens=T.token_estimate) -> DataFrame:
    """Payloads with first_parts and fallback_parts from the tokens of a source's ``text`` and an overhead for each payload."""
    sums = payloads.groupBy(*keys).agg(F.sum(tokens(text)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    parts = [batching.batch_count(F.col("_t"), F.col("_n"), b, overhead).alias(n) for b, n in ((budget, "first_parts"), (fallback, "fallback_parts"))]
    return payloads.join(sums.select(*keys, *parts), keys)


def content(payloads: DataFrame, keys: list[str], provider: str = "outline", retries: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """Store rows (keys, node_id, content) and states of sources; ``payloads``: keys, ord, node_id, hierarchy_path, start, end, points."""
    sized = payloads.withColumn("weight", batching.points_length(F.col("points")))
    sized = with_parts(sized, keys, F.array_join("points", "\n"), CONTENT_OVERHEAD, how.pop("budget", CONTENT_BUDGET), how.pop("fallback", CONTENT_FALLBACK))
    fields = ["hierarchy_path", F.array("start", "end").alias("range"), F.col("points").alias("content_points_list")]
    out, state = ladder(sized, keys, fields, "weight", "markdown", provider, retries=retries, **how)
    named = out.withColumnRenamed("text", "content")
    named.calls = records(out.answers, keys, "content", "batch", provider, how.get("which", ""))
    return named, state


def summaries(payloads: DataFrame, store: DataFrame, keys: list[str], provider: str = "digest", retries: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """Store rows (keys, node_id, summary) and states; a payload whose node the store lacks has no summary (``batching.without_content``)."""
    found = payloads.join(store.select(*keys, "node_id", "content"), [*keys, "node_id"]).withColumn("weight", F.length("content"))
    sized = with_parts(found, keys, F.col("content"), SUMMARY_OVERHEAD, how.pop("budget", SUMMARY_BUDGET), how.pop("fallback", SUMMARY_FALLBACK))
    out, state = ladder(sized, keys, ["hierarchy_path", F.col("content").alias("structured_content")], "weight", "summary", provider, retries=retries, **how)
    named = out.withColumnRenamed("text", "summary")
    named.calls = records(out.answers, keys, "summary", "batch", provider, how.get("which", ""))
    return named, state
