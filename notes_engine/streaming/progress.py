"""Progress of batch and streaming work, told to reporters."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

EVENT = "timestamp timestamp, node_name string, stage string, status string, message string, current long, total long"


@dataclass(frozen=True)
class Event:
    node_name: str
    stage: str
    status: str  # started, running, completed, failed or info
    message: str
    current: int | None = None
    total: int | None = None
    timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc))


class Progress:
    """Sends events to all reporters; one that fails is logged and keeps none of the others from its event."""

    def __init__(self, *reporters: Callable[[Event], None]):
        self.reporters = list(reporters)

    def tell(self, node_name: str, stage: str, status: str, message: str, current: int | None = None, total: int | None = None) -> None:
        event = Event(node_name, stage, status, message, current, total)
        for report in self.reporters:
            try:
                report(event)
            except Exception as e:
                log.warning("reporter %r failed: %s", report, e)

    def started(self, node_name: str, stage: str, message: str = "") -> None:
        self.tell(node_name, stage, "started", message or f"Starting {stage}")

    def running(self, node_name: str, stage: str, message: str, current: int | None = None, total: int | None = None) -> None:
        self.tell(node_name, stage, "running", message, current, total)

    def completed(self, node_name: str, stage: str, message: str = "") -> None:
        self.tell(node_name, stage, "completed", message or f"{stage} complete")

    def failed(self, node_name: str, stage: str, message: str = "") -> None:
        self.tell(node_name, stage, "failed", message or f"{stage} failed")

    def info(self, node_name: str, stage: str, message: str) -> None:
        self.tell(node_name, stage, "info", message)

    def observed(self, node_name: str, stage: str, df: DataFrame, act: Callable[[DataFrame], object], **metrics: Column) -> dict:
        """Run ``act`` on ``df`` and tell its start, its end with the ``metrics`` that Spark gathers on the way (rows among them), or its failure, which is raised."""
        seen = Observation(f"{node_name}/{stage}")
        self.started(node_name, stage)
        try:
            act(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]))
        except Exception as e:
            self.failed(node_name, stage, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            raise
        got = seen.get
        self.completed(node_name, stage, f"{stage} complete: " + ", ".join(f"{n}={v}" for n, v in got.items()))
        return got


class Recorded:
    """A reporter that keeps events, to be read as the table of progress."""

    def __init__(self):
        self.events: list[Event] = []

    def __call__(self, event: Event) -> None:
        self.events.append(event)

    def table(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in EVENT.split(", ")]
        return spark.createDataFrame([tuple(asdict(e)[n] for n in names) for e in self.events], EVENT)


class QueryProgress(StreamingQueryListener):
    """Tells the life of streaming queries, by their names; ``observe`` metrics of a batch are in its message."""

    def __init__(self, progress: Progress, stage: str = "stream"):
        self.progress, self.stage, self.names = progress, stage, {}

    def _name(self, run_id) -> str:
        return self.names.get(str(run_id), str(run_id))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self.progress.started(self._name(event.runId), self.stage)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        told = ", ".join(f"{k}.{n}={row[n]}" for k, row in sorted(p.observedMetrics.items()) for n in row.asDict())
        self.progress.running(self._name(p.runId), self.stage, f"batch {p.batchId}: {p.numInputRows} rows" + (f" ({told})" if told else ""), current=p.batchId + 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._name(event.runId)
        if event.exception:
            self.progress.failed(name, self.stage, event.exception.splitlines()[0])
        else:
            self.progress.completed(name, self.stage)
        self.names.pop(str(event.runId), None)


def histogram(rows: DataFrame, value: str, edges: list[float], by: list[str | Column]) -> DataFrame:
    """by, bucket, low, high, n: how many values lie in each bucket from one edge up to the next; bucket 0 is below the first, nulls are left out."""
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(value) >= e))
    low, high = F.array(F.lit(None).cast("double"), *[F.lit(float(e)) for e in edges]), F.array(*[F.lit(float(e)) for e in edges], F.lit(None).cast("double"))
    out = rows.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("*", F.get(low, F.col("bucket")).alias("low"), F.get(high, F.col("bucket")).alias("high"))
