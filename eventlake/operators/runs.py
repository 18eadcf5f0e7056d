"""Runs, chunks and slices of ordered rows.

Operators with keys work within each key. Those over one global order number the
rows by a range partitioning and a prefix sum over its partitions, so no task
ever holds more than its range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import unused, written


def group_while(df: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """Number the maximal runs of consecutive rows, from 1.

    ``same`` tells whether a row goes on with the run of the row before it; it
    may refer to that row's columns as ``prev.<column>``, so df has no column
    ``prev``. A null counts as no.
    """
    if "prev" in df.columns:
        raise ValueError("the name prev stands for the row before; rename the column")
    w = Window.partitionBy(*keys).orderBy(*order)
    (opens,) = unused(df, "opens")
    held = df.withColumn("prev", F.lag(F.struct(*df.columns)).over(w))
    marked = held.withColumn(opens, F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return marked.withColumn(name, F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("prev", opens)


def limited_runs(runs: DataFrame, keys: list[str], most: int, name: str = "run", strict: bool = True) -> DataFrame:
    """Runs with their sizes; a run of more than ``most`` rows is an error, or marked where strict is off."""
    counted = runs.groupBy(*keys, name).agg(F.count("*").alias("n"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"a run has more than {most} rows: "), F.col("n").cast("string"))).cast("boolean")
        return counted.withColumn("overflow", F.when(F.col("n") <= most, F.lit(False)).otherwise(wrong))
    return counted.withColumn("overflow", F.col("n") > most)


def idle_sessions(df: DataFrame, keys: list[str], at: str, idle_ms: int, *order: str) -> DataFrame:
    """Runs that end where more than idle_ms pass without a row."""
    return group_while(df, keys, [at, *order], F.col(at) - F.col(f"prev.{at}") <= idle_ms, "session")


def indexed(df: DataFrame, order: list[str], name: str = "index", weight: Column | None = None) -> DataFrame:
    """Each row's place (from 0) in one global order, or the total weight of the rows up to it.

    Rows are dealt out by ranges of the order and written; the few numbers of
    each partition are summed up first, then every partition numbers its own rows.
    """
    part, own, total, base = unused(df, "part", "own", "total", "base")
    dealt = df.repartitionByRange(*(F.col(c) for c in order)).withColumn(part, F.spark_partition_id())
    dealt = written(dealt.withColumn(own, F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")), "ranges")
    parts = dealt.groupBy(part).agg(F.sum(own).alias(total))
    before = F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select(part, F.coalesce(before, F.lit(0)).alias(base))
    so_far = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col(base) + F.sum(own).over(so_far) - (1 if weight is None else 0)
    return dealt.join(F.broadcast(bases), part).withColumn(name, place).drop(part, own, base)


def chunk_by_count(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Chunks of ``size`` rows in one global order, numbered from 0."""
    (at,) = unused(df, "at")
    return indexed(df, order, at).withColumn(name, F.floor(F.col(at) / size)).drop(at)


def chunk_by_weight(df: DataFrame, order: list[str], weight: Column, size: int, name: str = "chunk") -> DataFrame:
    """Chunks of rows whose weights add up: a row belongs to the chunk that its weights' total so far falls into."""
    (at,) = unused(df, "at")
    return indexed(df, order, at, weight).withColumn(name, F.floor((F.col(at) - 1) / size)).drop(at)


def chunk_within(df: DataFrame, keys: list[str], order: list[str], at: str, size: int, most_ms: int, name: str = "chunk") -> DataFrame:
    """Chunks within each key, numbered from 0: a chunk ends with its ``size``-th row, or before the row that comes most_ms or more after its first.

    The place of a chunk's end depends on where it began, so a key's rows are
    gone through in order by one task each, holding nothing but the last start.
    """
    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    dealt = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, n, began = None, 0, 0, 0
        for batch in batches:
            out = []
            for *key, ms in zip(*(batch.column(c).to_pylist() for c in (*keys, at))):
                if key != here:
                    here, number, n, began = key, 0, 0, ms
                elif n >= size or ms - began >= most_ms:
                    number, n, began = number + 1, 0, ms
                n += 1
                out.append(number)
            yield batch.append_column(name, pa.array(out, pa.int64()))

    return dealt.mapInArrow(run, schema)


def drop_until_next(df: DataFrame, keys: list[str], order: str, matches: Column, keep_last: bool = False) -> DataFrame:
    """Each key's rows from the one before its first match on.

    Without a match nothing is left, or with keep_last the last row. ``order``
    must number a key's rows without ties.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    hit, begun, last = unused(df, "hit", "begun", "last")
    up_to_next = by.rowsBetween(Window.unboundedPreceding, 1)  # a match in the next row counts already
    marked = df.withColumn(hit, F.coalesce(matches, F.lit(False)))
    marked = marked.withColumns({begun: F.max(hit).over(up_to_next), last: F.lead(F.lit(True)).over(by).isNull()})
    wanted = F.col(begun) | F.col(last) if keep_last else F.col(begun)
    return marked.where(wanted).drop(hit, begun, last)


def route_selected(df: DataFrame, selected: Column, target: dict[str, Column]) -> DataFrame:
    """Selected rows with some columns replaced, the others as they are."""
    return df.withColumns({c: F.when(F.coalesce(selected, F.lit(False)), new).otherwise(F.col(c)) for c, new in target.items()})


def run_targets(df: DataFrame, keys: list[str], order: list[str], selected: Column, target: Callable[[DataFrame], DataFrame], name: str = "run") -> DataFrame:
    """Each maximal run of selected rows goes through ``target`` as a whole, the others stay as they are.

    target gets the selected rows of all runs with the keys and the run's number
    (unique within the key), and may change, join or leave out rows of a run; it
    returns the same columns, of which the order columns place its rows among
    the others.
    """
    (own,) = unused(df, "selected")
    flagged = df.withColumn(own, F.coalesce(selected, F.lit(False)))
    numbered = group_while(flagged, keys, order, F.col(own) == F.col(f"prev.{own}"), name)
    done = target(numbered.where(own).drop(own))
    return numbered.where(~F.col(own)).drop(own).unionByName(done)


def neighbours(df: DataFrame, keys: list[str], start: str, name: str = "end") -> DataFrame:
    """Adjacent slices: each row's end is the next one's start (null for the last, which stays open)."""
    return df.withColumn(name, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))
