"""Where queries are registered under their names, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import log
from ..tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"

#: The log of the table events, for the SQL side.
LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS persistence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_nr,
         epoch_us(ts) // 1000 AS timestamp_ms, event_type AS tag, props AS event, value, event_id
  FROM events WHERE user_id IS NOT NULL)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{LOG}", LOG)
        return f

    return add


def entity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.events_log(read_table(spark, sf_dir, "events"))
