"""Parts of a source merged into one: hierarchies in part order, content stores without repeated ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_folder(mode: Column, part_title: Column) -> Column:
    """Where a part's artefacts lie: artifacts, or artifacts/<part> of a source in several parts."""
    return F.when(mode == "single", F.lit("artifacts")).otherwise(F.concat(F.lit("artifacts/"), part_title))


def hierarchies(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of all parts (keys, part_idx, node_pos, parent_pos, ...) as one tree, numbered on in part order."""
    sizes = nodes.groupBy(*keys, "part_idx").agg(F.max("node_pos").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("part_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "part_idx", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_base"))
    moved = nodes.join(base, [*keys, "part_idx"])
    parent = F.when(F.col("parent_pos") == 0, 0).otherwise(F.col("parent_pos") + F.col("_base"))
    return moved.withColumns({"parent_pos": parent, "node_pos": F.col("node_pos") + F.col("_base")}).drop("_base")


def stores(store: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merged store rows (keys, part_idx, node_id, ...), and (keys, problem) of sources whose parts repeat an id; those are left out."""
    times = store.groupBy(*keys, "node_id").agg(F.count_distinct("part_idx").alias("parts")).where("parts > 1")
    problem = F.concat(F.lit("repeated: "), F.array_join(F.array_sort(F.collect_list("node_id")), ", "))
    problems = times.groupBy(*keys).agg(problem.alias("problem"))
    return store.join(problems, keys, "left_anti").drop("part_idx"), problems


def missing_parts(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part_idx) of parts that are expected and have no artefact."""
    return expected.select(*keys, "part_idx").distinct().join(found.select(*keys, "part_idx"), [*keys, "part_idx"], "left_anti")
