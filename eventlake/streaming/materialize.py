"""Materialized views: a log, as a stream or a bounded replay, applied to a table in each entity's order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import events_of_keys
from ..tables import unused
from . import progress

Apply = Callable[[DataFrame, int], None]


def ordered(batch: DataFrame, key: str = "persistence_id") -> DataFrame:
    """A batch dealt out by entity, each partition in time and number order: what an apply function writes."""
    return batch.repartition(F.col(key)).sortWithinPartitions("timestamp_ms", key, "sequence_nr")


def materialize(log: DataFrame, apply: Apply, checkpoint: str, late: str | None = None, trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Apply a streaming log batch by batch, at least once, no event dropped however late.

    A batch's repeated events are applied once. Events that come again in later
    batches are applied again, as after a failure the same batch comes again
    under the same number: an apply function that merges by (persistence_id,
    sequence_nr) is exact (see upsert_parquet). ``late`` is a memory of repeated
    events over batches: with it, those within that time are left out before
    they reach apply, but so are events that come later than it; the view of
    such a stream needs a replay of their slice. A ``name`` makes the stream tell
    its progress (see progress.record).
    """
    once = log
    if name is not None:
        once = progress.observed(once)
    if late is not None:
        (time,) = unused(log, "_time")
        timed = once.withColumn(time, F.timestamp_millis("timestamp_ms")).withWatermark(time, late)
        once = timed.dropDuplicatesWithinWatermark(["persistence_id", "sequence_nr"]).drop(time)

    def step(batch: DataFrame, number: int) -> None:
        held = ordered(batch.dropDuplicates(["persistence_id", "sequence_nr"])).persist()  # apply may read it several times
        try:
            apply(held, number)
        finally:
            held.unpersist()

    writer = once.writeStream if name is None else once.writeStream.queryName(name)
    return writer.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(log: DataFrame, apply: Apply, start_ms: int = 0, end_ms: int | None = None) -> None:
    """Apply one time slice [start_ms, end_ms) of a log as a batch; slices may run at the same time as different jobs.

    The batch's number is negative and tells the slice, so the same slice again
    replaces itself and no other.
    """
    part = log.where(F.col("timestamp_ms") >= start_ms)
    apply(ordered(part if end_ms is None else part.where(F.col("timestamp_ms") < end_ms)), _number("slice", start_ms, end_ms))


def reimport(log: DataFrame, keys: DataFrame, apply: Apply, now_ms: int, rollback_ms: int = 10_000) -> None:
    """Apply some entities' events from the beginning up to now less the rollback, beside the running stream."""
    apply(ordered(events_of_keys(log, keys, now_ms - rollback_ms)), _number("keys", now_ms, uuid.uuid4().hex))


def _number(*what: object) -> int:
    """A negative batch number that stands for these values."""
    return -1 - int.from_bytes(hashlib.sha256(repr(what).encode()).digest()[:7], "big")


#: Folders that a batch's rows are dealt to by their keys.
BUCKETS = 64


def upsert_parquet(spark: SparkSession, path: str, keys: list[str]) -> Apply:
    """An apply function that appends each batch under its number: a repeated batch replaces itself, no other one.

    Rows whose keys another batch has written (a replay, an event that came
    again) are left out; only the key columns of the buckets that the batch's own
    keys are in are read for that. Batches that run at the same time may both
    write a row: ``merged`` reads it once. For a view with one row a key, updated
    in place, see sources.control.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        try:
            own = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            known = spark.read.option("basePath", path).parquet(path).where((F.col("batch") != number) & F.col("bucket").isin(own)).select("bucket", *keys)
            rows = rows.join(known, ["bucket", *keys], "left_anti").select(*rows.columns)
        except AnalysisException as missing:  # the first batch
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return apply


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of a folder of batches, one for each key: that of the highest batch number, replays before all stream batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("batch", "bucket")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*").select(*columns)
