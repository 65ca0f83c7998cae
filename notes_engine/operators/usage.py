"""Costs and usage reports over a log of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["node_name", "operation_name", "provider", "model"]


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with estimated_cost; null for an unknown price or token count.

    ``prices``: provider, model, in_per_1k, out_per_1k; names in any case.  Spark
    sends the table to all tasks if it is small.
    """
    p = prices.select(F.lower("provider").alias("_p"), F.lower("model").alias("_m"), "in_per_1k", "out_per_1k")
    joined = calls.join(p, (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left")
    cost = F.round(F.col("input_tokens") / 1000 * F.col("in_per_1k") + F.col("output_tokens") / 1000 * F.col("out_per_1k"), 8)
    return joined.withColumn("estimated_cost", cost).drop("_p", "_m", "in_per_1k", "out_per_1k")


def summary(calls: DataFrame, by: list[str] = BY, keys: list[str] | None = None) -> DataFrame:
    """One pass over the calls: keys, dimension, value, and totals by each dimension and over all.

    ``keys`` name a run.  Without them, no calls give one row of zeros, with a null cost.
    """
    keys = keys or []
    # An empty row keeps the total of no calls.
    none = calls.sparkSession.range(0 if keys else 1).select(F.lit(False).alias("_real"))
    calls = calls.withColumn("_real", F.lit(True)).unionByName(none, allowMissingColumns=True)
    sums = [
        F.count_if("_real").alias("calls"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
        F.round(F.sum("estimated_cost"), 8).alias("cost"), F.round(F.coalesce(F.sum("duration_ms"), F.lit(0.0)), 2).alias("duration_ms"),
    ]
    own = [F.col(k) for k in keys]
    sets = [[*own, F.col(c)] for c in by] + [own]
    out = calls.groupingSets(sets, *own, *[F.col(c) for c in by]).agg(*sums, *[F.grouping(c).alias(f"_g_{c}") for c in by])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        name, value = F.when(F.col(f"_g_{c}") == 0, c).otherwise(name), F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    out = out.where((F.col("calls") > 0) | (F.least(*[F.col(f"_g_{c}") for c in by], F.lit(1)) == 1))
    return out.select(*keys, name.alias("dimension"), value.alias("value"), "calls", "ok", "failed", "input_tokens", "output_tokens", "total_tokens", "cost", "duration_ms")


def money(x: Column) -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string("$%.6f", x))


def call_tokens(tokens: Column) -> Column:
    """Tokens of a call in the table of calls; none and 0 are N/A."""
    return F.when(F.coalesce(tokens, F.lit(0)) == 0, "N/A").otherwise(tokens.cast("string"))


LABELS = {"node_name": "Node", "operation_name": "Operation", "provider": "Provider", "model": "Model"}


def _row(*cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def report_lines(calls: DataFrame, keys: list[str], generated: Column, order: str = "started_at") -> DataFrame:
    """keys, section, pos, name, line: the six sections of the usage report of each run, as rows.

    Calls are numbered by ``order`` within a run.  A run is a group of ``keys``.
    """
    s = summary(calls, keys=keys)
    whole, big, ms = s.where("dimension = 'all'"), lambda c: F.format_number(c, 0), F.format_number("duration_ms", 1)
    metrics = [("Total Calls", F.col("calls")), ("Successful Calls", F.col("ok")), ("Failed Calls", F.col("failed")), ("Total Input Tokens", big("input_tokens")), ("Total Output Tokens", big("output_tokens")),
               ("Total Tokens", big("total_tokens")), ("Estimated Total Cost", money(F.col("cost"))), ("Total Duration", F.concat(ms, F.lit(" ms")))]
    head = [F.lit("# LLM Usage Report\n"), F.concat(F.lit("_Generated at "), generated, F.lit("_\n")), F.lit("## Pipeline Summary\n"), F.lit("| Metric | Value |"), F.lit("|---|---|")]
    fixed = [(0, F.array(*head, *[_row(F.lit(n), v) for n, v in metrics], F.lit("")))]
    columns = "Calls | Success | Failed | Input Tokens | Output Tokens | Total Tokens | Cost | Duration (ms) |\n|---|---|---|---|---|---|---|---|---|"
    fixed += [(2 * k + 1, F.array(F.lit(f"## Per-{label} Breakdown\n"), F.lit(f"| {label} | {columns}"))) for k, label in enumerate(LABELS.values())]
    fixed += [(9, F.array(F.lit("## Individual Calls\n"), F.lit("| # | Node | Operation | Provider | Model | Input | Output | Tokens | Cost | Duration (ms) | Status |\n|---|---|---|---|---|---|---|---|---|---|---|"))), (11, F.array(F.lit("")))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), lines.alias("lines")) for n, lines in fixed]))
    out = whole.select(*keys, each.alias("x")).select(*keys, "x.section", F.posexplode("x.lines").alias("pos", "line")).select(*keys, "section", F.col("pos").cast("long").alias("pos"), F.lit("").alias("name"), "line")
    place = F.coalesce(*[F.when(F.col("dimension") == d, 2 * k + 2) for k, d in enumerate(LABELS)])
    line = _row(F.col("value"), F.col("calls"), F.col("ok"), F.col("failed"), big("input_tokens"), big("output_tokens"), big("total_tokens"), money(F.col("cost")), ms)
    out = out.unionByName(s.where("dimension != 'all'").select(*keys, place.alias("section"), F.lit(0).cast("long").alias("pos"), F.col("value").alias("name"), line.alias("line")))
    gaps = F.explode(F.array(*[F.lit(2 * k + 2) for k in range(len(LABELS))]))
    out = out.unionByName(whole.select(*keys, gaps.alias("section"), F.lit(1).cast("long").alias("pos"), F.lit("").alias("name"), F.lit("").alias("line")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    state = F.concat(F.when(F.col("success"), "✅").otherwise("❌"), F.when(F.coalesce("exception_type", F.lit("")) == "", "").otherwise(F.concat(F.lit(" `"), F.col("exception_type"), F.lit("`"))))
    tick = F.concat(F.lit("`"), F.col("model"), F.lit("`"))
    numbered = calls.withColumn("pos", number)
    line = _row(F.col("pos"), F.col("node_name"), F.col("operation_name"), F.col("provider"), tick, call_tokens(F.col("input_tokens")), call_tokens(F.col("output_tokens")), call_tokens(F.col("total_tokens")),
                money(F.col("estimated_cost")), F.format_string("%.1f", "duration_ms"), state)
    return out.unionByName(numbered.select(*keys, F.lit(10).alias("section"), "pos", F.lit("").alias("name"), line.alias("line")))


def report(calls: DataFrame, keys: list[str], generated: Column, order: str = "started_at") -> DataFrame:
    """keys, report: the usage report of each run as one markdown text, of as many lines as the run has calls, about."""
    line = F.struct("section", "pos", "name", "line")
    lines = F.array_sort(F.collect_list(line))
    return report_lines(calls, keys, generated, order).groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"))


def json_report(calls: DataFrame, keys: list[str], order: str = "started_at") -> DataFrame:
    """keys, report: calls in order, summary, and totals per node, operation, provider and model of each run, as JSON."""
    s = summary(calls, keys=keys)
    stats = F.struct("calls", F.col("ok").alias("successful"), "failed", "input_tokens", "output_tokens", "total_tokens", F.col("cost").alias("estimated_cost"), "duration_ms")
    per = lambda d: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("value", stats.alias("stats"))))))
    total = F.struct(F.col("calls").alias("total_calls"), F.col("ok").alias("successful_calls"), F.col("failed").alias("failed_calls"), F.col("input_tokens").alias("total_input_tokens"),
                     F.col("output_tokens").alias("total_output_tokens"), "total_tokens", F.col("cost").alias("estimated_total_cost"), F.col("duration_ms").alias("total_duration_ms"))
    names = {"node_name": "per_node", "operation_name": "per_operation", "provider": "per_provider", "model": "per_model"}
    totals = s.groupBy(*keys).agg(F.first(F.when(F.col("dimension") == "all", total), ignorenulls=True).alias("summary"), *[per(d).alias(n) for d, n in names.items()])
    fields = [c for c in calls.columns if c not in keys]
    listed = calls.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("call")))), lambda x: x["call"]).alias("calls"))
    body = F.to_json(F.struct("calls", "summary", *names.values()), {"ignoreNullFields": "false"})
    return listed.join(totals, keys).select(*keys, body.alias("report"))


WIDTH = 48  # of a line that is written over


def progress_line(status: Column, stage: Column, message: Column, current: Column, total: Column) -> Column:
    """What the console shows of a progress event; a failure has a second line for its message."""
    told = F.concat(F.lit("    "), message)
    count = F.concat(told, F.lit("  ("), current.cast("string"), F.lit(" / "), total.cast("string"), F.lit(")"))
    padded = F.when(F.length(count) >= WIDTH, count).otherwise(F.rpad(count, WIDTH, " "))
    return (
        F.when(status == "started", F.concat(F.lit("⟳ "), stage))
        .when(status == "completed", F.concat(F.lit("✓ "), stage))
        .when(status == "failed", F.concat(F.lit("✗ "), stage, F.when(F.coalesce(message, F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), told))))
        .when(status == "info", F.concat(F.lit("· "), message))
        .when(current.isNotNull() & total.isNotNull(), padded)
        .otherwise(told)
    )
