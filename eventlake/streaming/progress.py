"""Progress of materializing streams: what each trigger saw, kept as a table that anyone can ask."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "progress"
SCHEMA = "stream string, run string, batch long, events long, offset_ms long, delay_ms long, remaining_ms long, took_ms long, at_ms long, failed string"


def observed(log: DataFrame) -> DataFrame:
    """A streaming log that counts its events and tells the latest time it has seen, while they pass."""
    return log.observe(METRICS, F.count("*").alias("events"), F.max("timestamp_ms").alias("offset_ms"))


class Recorder(StreamingQueryListener):
    """Appends a row to a table for each trigger that saw events, and one for a stream that failed.

    delay is how far the latest event seen lies behind the clock, remaining how far
    it lies before the end of the time that the stream is to cover (none: null).
    """

    def __init__(self, spark: SparkSession, path: str, until_ms: dict[str, int] | None = None, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.path, self.until, self.now = spark, path, until_ms or {}, now_ms
        self.names: dict[str, str] = {}

    def _append(self, *row: object) -> None:
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(METRICS)
        if p.name is None or seen is None or not seen["events"]:
            return
        now, offset = self.now(), seen["offset_ms"]
        left = max(0, self.until[p.name] - offset) if p.name in self.until else None
        self._append(p.name, str(p.runId), p.batchId, seen["events"], offset, now - offset, left, p.batchDuration, now, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name is not None and event.exception:
            self._append(name, str(event.runId), None, 0, None, None, None, None, self.now(), event.exception[:1000])


def record(spark: SparkSession, path: str, until_ms: dict[str, int] | None = None) -> Recorder:
    """Keep the progress of all named streams of this session (materialize with a name) in a table; spark.streams.removeListener ends it."""
    recorder = Recorder(spark, path, until_ms)
    spark.streams.addListener(recorder)
    return recorder


def current(progress: DataFrame) -> DataFrame:
    """The state of each stream: offset, delay and remaining of its last trigger, all events so far, failures, number of runs."""
    order = F.struct("at_ms", "batch")
    latest = lambda c: F.max_by(c, F.when(F.col("offset_ms").isNotNull(), order)).alias(c)
    return progress.groupBy("stream").agg(
        *(latest(c) for c in ("batch", "offset_ms", "delay_ms", "remaining_ms")), F.sum("events").alias("events"), F.count("failed").alias("failures"), F.countDistinct("run").alias("runs")
    )
