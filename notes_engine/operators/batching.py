"""Batches of payloads for a model function, and the checks on what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import equal_weight

RETRYABLE = ["duplicate", "incorrect_ids"]


def batch_count(tokens: Column, nodes: Column, budget: int, overhead: int) -> Column:
    """Batches that a budget of tokens allows, with an overhead for each node."""
    return F.greatest(F.lit(1), F.ceil((tokens + nodes * overhead) / budget)).cast("long")


def batches(payloads: DataFrame, keys: list[str], weight: str, parts: int | Column, order: str = "ord") -> DataFrame:
    """Payloads with batch_id and temp_id N1, N2, ... in each batch; numbers of empty batches are not used."""
    cut = equal_weight(payloads, keys, [order], weight, parts, "batch_no")
    within = Window.partitionBy(*keys, "batch_no").orderBy(order)
    named = cut.withColumn("temp_id", F.concat(F.lit("N"), F.row_number().over(within).cast("string")))
    return named.withColumn("batch_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("batch_no").cast("string")))


def batch_input(batched: DataFrame, *fields: str | Column, keys: list[str] | None = None) -> DataFrame:
    """keys, batch_id, input, n: the payloads of a batch as JSON, in order, and their number."""
    row = F.struct("ord", F.struct(F.col("temp_id").alias("id"), *fields).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["item"])
    return batched.groupBy(*(keys or []), "batch_id").agg(F.to_json(items).alias("input"), F.count(F.lit(1)).alias("n"))


def points_length(points: Column) -> Column:
    """Characters of all points of a payload."""
    return F.aggregate(points, F.lit(0).cast("long"), lambda n, p: n + F.length(p))


def content_length(payloads: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads with the length of their node's content; ``without_content`` names those that have none."""
    return payloads.join(store.select(*keys, "node_id", F.length("content").alias("content_length")), [*keys, "node_id"])


def without_content(payloads: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads whose node is not in the store: errors."""
    return payloads.join(store.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")


def ending_within(payloads: DataFrame, first: int, last: int) -> DataFrame:
    """Payloads whose end point is in a range, both ends included."""
    return payloads.where(F.col("end").between(first, last))


def checked(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """batch_id, n_expected, n_returned, status of every batch.

    ``expected`` and ``returned``: batch_id, temp_id.  The status is count,
    duplicate, incorrect_ids or ok; the first that applies.
    """
    side = lambda df, e, r: df.select("batch_id", "temp_id", F.lit(e).alias("expected"), F.lit(r).alias("returned"))
    return tallied(side(expected, 1, 0).unionByName(side(returned, 0, 1)))


def tallied(sides: DataFrame) -> DataFrame:
    """``checked`` for expected and returned ids in one table: batch_id, temp_id, expected, returned (1 or 0)."""
    ids = sides.groupBy("batch_id", "temp_id").agg(F.max("expected").alias("e"), F.sum("returned").alias("r"))
    both = ids.groupBy("batch_id").agg(
        F.sum("e").cast("long").alias("n_expected"), F.sum("r").alias("n_returned"), F.count_if(F.col("r") > 1).alias("twice"), F.count_if((F.col("e") == 0) | (F.col("r") == 0)).alias("wrong"))
    status = F.when(F.col("n_expected") != F.col("n_returned"), "count").when(F.col("twice") > 0, "duplicate").when(F.col("wrong") > 0, "incorrect_ids").otherwise("ok")
    return both.select("batch_id", "n_expected", "n_returned", status.alias("status"))


def repeats(returned: DataFrame, order: str) -> DataFrame:
    """batch_id, temp_id, repeat, ``order`` of each row whose id came before in its batch, in that order: 1 for the second one, and so on."""
    number = F.row_number().over(Window.partitionBy("batch_id", "temp_id").orderBy(order)) - 1
    return returned.select("batch_id", "temp_id", number.alias("repeat"), order).where("repeat > 0")


def missing_and_unexpected(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """batch_id, temp_id, side of ids on one side only."""
    on = ["batch_id", "temp_id"]
    return expected.select(*on).join(returned, on, "left_anti").distinct().withColumn("side", F.lit("missing")).unionByName(
        returned.select(*on).join(expected, on, "left_anti").distinct().withColumn("side", F.lit("unexpected")))


def restored(batched: DataFrame, returned: DataFrame, text: str = "text") -> DataFrame:
    """Payloads with the returned text under their own ids."""
    return batched.join(returned.select("batch_id", "temp_id", text), ["batch_id", "temp_id"], "left")


def complete(items: DataFrame, keys: list[str], *fields: str) -> DataFrame:
    """keys, complete: every item has text in every field; true for none."""
    full = F.lit(True)
    for f in fields:
        full = full & (F.coalesce(f, F.lit("")) != "")
    return items.groupBy(*keys).agg(F.coalesce(F.bool_and(full), F.lit(True)).alias("complete"))


def retryable(status: Column, transient: Column) -> Column:
    return status.isin(RETRYABLE) | ((status == "call") & transient)
