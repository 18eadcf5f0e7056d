"""The event log: an append-only table with one ordered sequence of events for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import to_millis
from ..tables import unused

ENVELOPE = ("persistence_id", "sequence_nr", "timestamp_ms", "tag", "event")


def as_log(events: DataFrame, key: Column, order: list[Column], at: Column, tag: Column, event: Column, *more: Column) -> DataFrame:
    """Number a table of events within each entity and shape it as a log (plus further columns).

    Rows without a key belong to no entity and are left out. Ties in ``order``
    must be broken by its last column for a repeatable numbering.
    """
    numbered = events.where(key.isNotNull()).withColumn("_nr", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.select(
        key.cast("string").alias("persistence_id"), F.col("_nr").cast("bigint").alias("sequence_nr"), F.unix_millis(at.cast("timestamp")).alias("timestamp_ms"), tag.alias("tag"), event.alias("event"), *more
    )


def events_log(events: DataFrame) -> DataFrame:
    """The table ``events`` as a log: users are entities, event types tags, props payloads; value stays."""
    return as_log(events, F.col("user_id"), [F.col("ts"), F.col("event_id")], F.col("ts"), F.col("event_type"), F.col("props"), F.col("value"), F.col("event_id"))


def store(log: DataFrame, path: str, day_ms: int = 86_400_000, number: int = 0) -> None:
    """Write a numbered log, so that later reads need no numbering and skip other tags and days.

    Rows of a tag and day go to one folder, sorted by time: filters on tag and
    timestamp_ms then reach the scan (see stored). Spark splits a tag's day that
    is too large for a task. What was stored under the same number before is replaced.
    """
    day = F.floor(F.col("timestamp_ms") / day_ms).cast("bigint")
    dealt = log.withColumn("day", day).hint("rebalance", "tag", "day").sortWithinPartitions("tag", "day", "timestamp_ms")
    dealt.write.mode("overwrite").partitionBy("tag", "day").parquet(f"{path}/batch={number}")


def stored(spark: SparkSession, path: str, tag: str | None = None, since_ms: int | None = None, until_ms: int | None = None, day_ms: int = 86_400_000) -> DataFrame:
    """A stored log, all numbers together, or the part of it of a tag from a time on and before another; only that part's folders are read."""
    found = spark.read.option("basePath", path).parquet(path)
    if tag is not None:
        found = found.where(F.col("tag") == tag)
    if since_ms is not None:
        found = found.where((F.col("day") >= since_ms // day_ms) & (F.col("timestamp_ms") >= since_ms))
    if until_ms is not None:
        found = found.where((F.col("day") <= until_ms // day_ms) & (F.col("timestamp_ms") < until_ms))
    return found.drop("day", "batch")


def events_by_tag(log: DataFrame, tag: str, since: str | int | None = None, until: str | int | None = None) -> DataFrame:
    """Events of a tag from ``since`` on (milliseconds or ISO text) and before ``until``.

    The filters reach the scan of a stored log; a log that is numbered on the
    fly is numbered whole before.
    """
    found = log.where(F.col("tag") == tag)
    if since is not None:
        found = found.where(F.col("timestamp_ms") >= to_millis(F.lit(str(since))))
    if until is not None:
        found = found.where(F.col("timestamp_ms") < to_millis(F.lit(str(until))))
    return found


def events_by_key(log: DataFrame, persistence_id: str, first: int = 0, last: int | None = None) -> DataFrame:
    """The history of one entity, in order."""
    found = log.where((F.col("persistence_id") == persistence_id) & (F.col("sequence_nr") >= first))
    return (found if last is None else found.where(F.col("sequence_nr") <= last)).orderBy("sequence_nr")


def events_of_keys(log: DataFrame, keys: DataFrame, before_ms: int | None = None) -> DataFrame:
    """Selective replay: the events of given entities, of those before a time if one is given.

    keys needs a column persistence_id; Spark broadcasts it if it is known to be
    small and shuffles both sides otherwise.
    """
    found = log if before_ms is None else log.where(F.col("timestamp_ms") < before_ms)
    return found.join(keys.select("persistence_id").distinct(), "persistence_id", "left_semi")


def deduplicated(log: DataFrame) -> DataFrame:
    """At-least-once input made once: one row for each entity and sequence number."""
    return log.dropDuplicates(["persistence_id", "sequence_nr"])


def contiguous_prefix(log: DataFrame) -> DataFrame:
    """Each entity's events from number 1 up to its first gap; repeated events count once."""
    order = Window.partitionBy("persistence_id").orderBy("sequence_nr")
    (n,) = unused(log, "n")
    return deduplicated(log).withColumn(n, F.row_number().over(order)).where(F.col("sequence_nr") == F.col(n)).drop(n)


def require_rows(df: DataFrame) -> DataFrame:
    """df itself, after an early check that it can be read at all: errors come here, not in the middle of a stream."""
    df.limit(1).collect()
    return df
