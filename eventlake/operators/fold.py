"""Ordered folds of events into state: generic, latest value, access rights, token buckets, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


@dataclass(frozen=True)
class Fold:
    """A left fold: state starts as ``init``, ``step(state, event)`` gives the next, ``finish(state)`` the result.

    step must return exactly init's type. In a batch it becomes the built-in
    ``aggregate`` over an entity's events, so one entity's events must fit in a
    task's memory; folds that are sums, maxima or last values should be plain
    aggregations instead (see latest_state), which combine before the shuffle.
    """

    init: Column
    step: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = staticmethod(lambda state: state)

    def over(self, events: Column) -> Column:
        return F.aggregate(events, self.init, self.step, self.finish)


def fold_by_key(log: DataFrame, fold: Fold, key: str = "persistence_id", order: str = "sequence_nr", columns: tuple[str, ...] = ("tag", "event")) -> DataFrame:
    """(key, state): each entity's events folded in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return log.groupBy(key).agg(fold.over(rows).alias("state"))


def latest_state(log: DataFrame, columns: list[str], key: str = "persistence_id", order: str = "sequence_nr") -> DataFrame:
    """Each entity's last event: one row combined before the shuffle, no sort."""
    last = F.max_by(F.struct(order, *columns), order)
    return log.groupBy(key).agg(last.alias("_last")).select(key, f"_last.{order}", *(f"_last.{c}" for c in columns))


def acl(changes: DataFrame, right: str = "right", target: str = "target", granted: str = "granted", order: str = "order") -> DataFrame:
    """(right, target) pairs that hold after all grants and revocations: the last change of a pair decides."""
    return changes.groupBy(right, target).agg(F.max_by(granted, order).alias("_granted")).where("_granted").select(right, target)


def is_granted(rights: DataFrame, users: DataFrame, right: str = "right", target: str = "target") -> DataFrame:
    """users (user, groups) with the rights they hold themselves or through a group."""
    who = users.select("user", F.explode(F.array_union(F.array("user"), F.coalesce("groups", F.array().cast("array<string>")))).alias(target))
    return who.join(rights, target).select("user", right).distinct()


def sole_owners(rights: DataFrame, right: str = "right", target: str = "target") -> DataFrame:
    """Rights that exactly one target holds."""
    held = rights.groupBy(right).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    return held.where(F.col("lo").eqNullSafe(F.col("hi"))).select(right, F.col("lo").alias(target))


def throttle(requests: DataFrame, key: str, at: str, tokens: int, refill_ms: int, burst: int) -> DataFrame:
    """(key, at, granted) of every request, each key with a bucket of its own.

    A bucket starts full with ``burst`` tokens; each refill_ms since its last
    filling add ``tokens``, up to burst; a request takes one if there is one.
    Requests of one key are gone through in order of time by one task, which
    holds nothing but the bucket. Null keys share a bucket; a null time is an error.
    """
    asked = requests.select(F.col(key), F.col(at).cast("bigint").alias(at))
    dealt = asked.repartition(F.col(key)).sortWithinPartitions(key, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, filled_at, left = object(), 0, 0
        for batch in batches:
            granted = []
            for who, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != here:
                    here, filled_at, left = who, now, burst
                periods = (now - filled_at) // refill_ms
                left, filled_at = min(burst, left + periods * tokens), filled_at + periods * refill_ms
                granted.append(left > 0)
                left -= left > 0
            yield batch.append_column("granted", pa.array(granted, pa.bool_()))

    return dealt.mapInArrow(run, StructType([*asked.schema.fields, StructField("granted", BooleanType())]))


def combined_offset(a: Column, b: Column) -> Column:
    """The progress of two branches together: the smaller one; 0 and null tell nothing."""
    return F.coalesce(F.least(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0))), F.lit(0))


def conflated(df: DataFrame, every: Column, at: str) -> DataFrame:
    """Of many progress values only the last of each period."""
    return df.groupBy(every.alias("period")).agg(F.max(at).alias("last"), F.min(at).alias("first"))


def running(df: DataFrame, keys: list[str], order: list[str], what: Column, name: str) -> DataFrame:
    """A running total within each key."""
    return df.withColumn(name, F.sum(what).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
