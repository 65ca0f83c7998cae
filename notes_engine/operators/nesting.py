"""Opening and closing tokens matched by depth.

The depth of a token is a running sum of openings less closings.  At one depth
openings and closings take turns, so a closing token's partner is the row before
it among those of its depth: two windows, no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _step(kind: Column) -> Column:
    return F.when(kind.endswith("_open"), 1).when(kind.endswith("_close"), -1).otherwise(0)


def with_depth(tokens: DataFrame, keys: list[str], pos: str = "pos", kind: str = "type") -> DataFrame:
    """``tokens`` with ``depth``: how many are open around each of them; an opening token and its partner have the same."""
    w = Window.partitionBy(*keys).orderBy(pos)
    step = _step(F.col(kind))
    return tokens.withColumn("depth", F.sum(step).over(w) - F.when(step > 0, 1).otherwise(0))


def _paired(tokens: DataFrame, keys: list[str], pos: str, kind: str) -> DataFrame:
    deep = with_depth(tokens, keys, pos, kind).where(_step(F.col(kind)) != 0)
    w = Window.partitionBy(*keys, "depth").orderBy(pos)
    return deep.withColumns({"_before": F.lag(F.struct(pos, kind)).over(w), "_after": F.lead(kind).over(w)})


def pairs(tokens: DataFrame, keys: list[str], pos: str = "pos", kind: str = "type") -> DataFrame:
    """keys, open_pos, close_pos, name, depth of all matching pairs of tokens ``name_open`` and ``name_close``.

    Tokens of other types count for nothing.  Where a key's tokens do not match
    (``problems``), its pairs are those of equal names at equal depths.
    """
    name = F.regexp_replace(kind, "_(open|close)$", "")
    rows = _paired(tokens, keys, pos, kind).where(F.col(kind).endswith("_close") & (F.col("_before")[kind] == F.concat(name, F.lit("_open"))))
    return rows.select(*keys, F.col("_before")[pos].alias("open_pos"), F.col(pos).alias("close_pos"), name.alias("name"), "depth")


def problems(tokens: DataFrame, keys: list[str], pos: str = "pos", kind: str = "type") -> DataFrame:
    """keys, problem, pos, expected, found: the first problem of each key whose tokens do not nest.

    ``closed``: a closing token with nothing open; ``crossed``: one that does not
    close what is open; ``unclosed``: the innermost token that is open at the end,
    looked for where there is nothing else.
    """
    rows = _paired(tokens, keys, pos, kind)
    closes, opens = F.col(kind).endswith("_close"), F.col(kind).endswith("_open")
    expected = F.regexp_replace(F.col("_before")[kind], "_open$", "_close")
    problem = F.when(closes & (F.col("depth") < 0), "closed").when(closes & ~F.coalesce(expected == F.col(kind), F.lit(False)), "crossed").when(opens & F.col("_after").isNull(), "unclosed")
    # Of open tokens the innermost is the last one; the others are told first come, first served.
    rank = F.when(F.col("_problem") == "unclosed", F.struct(F.lit(1).alias("late"), (-F.col(pos)).alias("at"))).otherwise(F.struct(F.lit(0).alias("late"), F.col(pos).cast("long").alias("at")))
    wanted = F.when(F.col("_problem") == "unclosed", F.regexp_replace(kind, "_open$", "_close")).when(F.col("_problem") == "crossed", expected)
    found = F.when(F.col("_problem") != "unclosed", F.col(kind))
    told = rows.withColumn("_problem", problem).where("_problem is not null")
    first = told.groupBy(*keys).agg(F.min_by(F.struct(F.col("_problem").alias("problem"), F.col(pos).alias("pos"), wanted.alias("expected"), found.alias("found")), rank).alias("_p"))
    return first.select(*keys, "_p.*")
