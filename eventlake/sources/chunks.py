"""Backup and restore: a log exported as chunk files of delimited messages, and replayed from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identifiers import chunk_key, chunk_start
from ..operators.runs import indexed
from ..tables import unused
from .framing import envelope_frame


EMPTY = "tag string, timestamp_ms bigint, persistence_id string, sequence_nr bigint, message binary, key string"


def backup(log: DataFrame, path: str, size: int = 10_000, mode: str = "append") -> None:
    """Write each tag's events, by time, as chunks of ``size`` events.

    A chunk's folder bears its tag and first time (chunks of a tag that begin in
    one millisecond share it); within it a row is one delimited message. Events
    are numbered without gathering them anywhere; a chunk is one file.
    """
    placed = indexed(log.select("tag", "timestamp_ms", "persistence_id", "sequence_nr", "event"), ["tag", "timestamp_ms", "persistence_id", "sequence_nr"], "place")
    tagged = placed.join(placed.groupBy("tag").agg(F.min("place").alias("begin")), "tag").withColumn("chunk", F.floor((F.col("place") - F.col("begin")) / size))
    first = tagged.groupBy("tag", "chunk").agg(F.min("timestamp_ms").alias("first"))
    keyed = tagged.join(first, ["tag", "chunk"]).withColumn("key", chunk_key(F.col("tag"), F.col("first")))
    message = envelope_frame("persistence_id", "sequence_nr", "timestamp_ms", F.col("event").cast("binary"))
    made = keyed.select("key", "tag", "timestamp_ms", "persistence_id", "sequence_nr", message.alias("message"))
    made.repartition("key").sortWithinPartitions("key", "timestamp_ms", "persistence_id", "sequence_nr").write.mode(mode).partitionBy("key").parquet(path)


def backup_stream(log: DataFrame, path: str, checkpoint: str, size: int = 10_000, trigger: dict | None = None) -> StreamingQuery:
    """Back up a streaming log as it comes: each batch's chunks go to its own folder, which a repeated batch replaces.

    Spark's checkpoint is the offset: it starts from nothing and goes on where it stopped.
    """
    step = lambda batch, number: backup(batch, f"{path}/batch={number}", size, "overwrite")
    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a backup; none where there is nothing yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], EMPTY)


def chunks(spark: SparkSession, path: str, tag: str, since_ms: int = 0) -> DataFrame:
    """The chunks of a tag that a restore from since_ms needs: from the last that starts before on (the last one if all do)."""
    keys = _read(spark, path).where(F.col("key").startswith(f"{tag}-from-")).select("key").distinct()
    keys = keys.withColumn("start_ms", chunk_start(F.col("key")))
    bound = F.coalesce(F.max(F.when(F.col("start_ms") < since_ms, F.col("start_ms"))), F.lit(since_ms))
    (name,) = unused(keys, "bound")
    return keys.join(F.broadcast(keys.agg(bound.alias(name))), F.col("start_ms") >= F.col(name)).drop(name)


def restore(spark: SparkSession, path: str, tag: str, since_ms: int = 0) -> DataFrame:
    """Messages of a tag to replay, in an order that keeps each entity's: sorted by entity and number within partitions; none where there is no backup."""
    wanted = chunks(spark, path, tag, since_ms).select("key")
    found = _read(spark, path).join(wanted, "key", "left_semi")
    return found.repartition("persistence_id").sortWithinPartitions("persistence_id", "sequence_nr")
