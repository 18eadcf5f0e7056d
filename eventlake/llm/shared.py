"""Small helpers of the text operators: those of the library's tables, argument checks, joins of crowded keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import new_path, read_table, shared_folder, unused, written  # noqa: F401


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def join_crowded(left: DataFrame, right: DataFrame, keys: list[str], crowded: Column) -> DataFrame:
    """left joined with right, which has one row a key; keys of which left has very many rows don't meet in one task.

    ``crowded`` tells which rows of right stand for such keys. They must be few:
    they are broadcast, the others are joined by a shuffle. Rows of left whose
    key is null, or isn't in right, are left out. left is read twice.
    """
    (flag,) = unused(left, "_crowded")
    hot = right.where(crowded).withColumn(flag, F.lit(True))
    near = left.join(F.broadcast(hot), keys, "left")
    cold = near.where(F.col(flag).isNull()).select(*left.columns).join(right.where(~crowded), keys)
    return near.where(flag).drop(flag).unionByName(cold)


def crowd(rows: int, least: int) -> int:
    """From how many rows on a key counts as crowded: no more than a thousand keys can, for each row's place in ``rows``."""
    return max(least, rows // 1000)
