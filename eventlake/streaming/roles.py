"""Roles of replicated entities: where an entity was first written it is a master, where its events arrive it is a slave.

What a site does with a message depends on its role for the entity, and that on the
entity's history there, or without one on what comes first: a write makes a master,
an event from elsewhere a slave; reads decide nothing. Masters reject events, slaves
reject writes. The rules are the same for a batch (outcomes) and a stream (replicate).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..tables import unused
from .stateful import in_order

MASTER, SLAVE = "master", "slave"
READ, WRITE, EVENT = "read", "write", "event"
#: What becomes of a message.
OK, NOT_FOUND, WRONG_SIDE, INVALID = "ok", "not found", "wrong side", "invalid first event"
APPENDED, DUPLICATE = "appended", "duplicate"


def _first(sites: Column) -> Column:
    return F.get(F.coalesce(sites, F.array().cast("array<string>")), F.lit(0))


def by_history(log: DataFrame, local: str) -> DataFrame:
    """(persistence_id, role, last_nr) of entities that have events, by the first event that names sites: a master where the first one named is ``local``.

    An entity none of whose events names sites is from before replication: its
    role is null until a migration names some (see migrations).
    log: (persistence_id, sequence_nr, sites).
    """
    first = F.min_by(_first(F.col("sites")), F.when(_first(F.col("sites")).isNotNull(), F.col("sequence_nr")))
    found = log.groupBy("persistence_id").agg(first.alias("role"), F.max("sequence_nr").alias("last_nr"))
    return found.withColumn("role", F.when(F.col("role") == local, MASTER).when(F.col("role").isNotNull(), SLAVE))


def migrations(log: DataFrame, local: str) -> DataFrame:
    """(persistence_id, sequence_nr, sites): for each entity from before replication the next event, which pins it to this site. Once stored, there is none any more."""
    old = by_history(log, local).where("role is null")
    return old.select("persistence_id", (F.col("last_nr") + 1).alias("sequence_nr"), F.array(F.lit(local)).alias("sites"))


def outcomes(history: DataFrame, messages: DataFrame, local: str) -> DataFrame:
    """messages with role (after the message; null: none yet) and outcome, each entity's in order of message_nr.

    messages: (persistence_id, message_nr, kind, sites, ...): kind is read, write or event,
    sites those that a write's event names. history: (persistence_id, sequence_nr, sites);
    entities from before replication count as migrated: masters. Without a history the first
    event, or the first write whose event names this site first, decides; reads before are
    not found, writes that name another site first are invalid and leave no trace.
    An event that a slave takes is ``ok`` here: visibility.apply_replica tells what is appended.
    """
    role, last, known, decides, first = unused(messages, "role", "last_nr", "_known", "_decides", "_first")
    past = by_history(history, local).select("persistence_id", F.coalesce("role", F.lit(MASTER)).alias(known))
    valid = (F.col("kind") == EVENT) | ((F.col("kind") == WRITE) & F.coalesce(_first(F.col("sites")) == local, F.lit(False)))
    so_far = Window.partitionBy("persistence_id").orderBy("message_nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = messages.join(past, "persistence_id", "left").withColumn(decides, F.when(valid, F.when(F.col("kind") == WRITE, MASTER).otherwise(SLAVE)))
    joined = joined.withColumn(first, F.first(decides, ignorenulls=True).over(so_far)).withColumn(role, F.coalesce(known, first))
    is_ = lambda kind: F.col("kind") == kind
    outcome = (
        F.when(F.col(role).isNull(), F.when(is_(READ), NOT_FOUND).when(is_(WRITE), INVALID))
        .when((is_(EVENT) & (F.col(role) == MASTER)) | (is_(WRITE) & (F.col(role) == SLAVE)), WRONG_SIDE)
        .otherwise(OK)
    )
    return joined.select(*messages.columns, F.col(role).alias("role"), outcome.alias("outcome"))


class Entity(StatefulProcessor):
    """One entity at one site: its role, the number of its last event, and events that came too early."""

    def __init__(self, local: str):
        self.local = local

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "role string, last long")
        self.waiting = handle.getMapState("waiting", "nr long", "timestamp_ms long, event string")

    def handleInitialState(self, key: Any, history: pd.DataFrame, timer_values: Any) -> None:
        """The role that the stored log decides (see by_history)."""
        row = history.iloc[0]
        self.about.update((row["role"] if isinstance(row["role"], str) else MASTER, int(row["last_nr"])))

    def _taken(self, last: int, nr: int, at: int, event: str) -> Iterator[tuple[int, int, str, str]]:
        """What a slave does with an event: (number, time, event, outcome) of it and of those it lets follow."""
        if nr <= last:
            yield nr, at, event, DUPLICATE
        elif nr > last + 1:
            self.waiting.updateValue((nr,), (at, event))
        else:
            yield nr, at, event, APPENDED
            while self.waiting.containsKey((nr + 1,)):
                nr += 1
                at, event = self.waiting.getValue((nr,))
                self.waiting.removeKey((nr,))
                yield nr, at, event, APPENDED

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        role, last = self.about.get() if self.about.exists() else (None, 0)
        out = []
        for message, kind, nr, at, sites, event in in_order(rows, "message_nr", "kind", "sequence_nr", "timestamp_ms", "sites", "event"):
            if kind == EVENT:
                role = role or SLAVE
                if role == MASTER:
                    out.append((key[0], message, role, WRONG_SIDE, None, None, None))
                for nr_, at_, event_, outcome in self._taken(last, int(nr), int(at), event) if role == SLAVE else ():
                    last = max(last, nr_)
                    out.append((key[0], message, role, outcome, nr_, at_, event_))
            elif kind == READ:
                out.append((key[0], message, role, OK if role else NOT_FOUND, None, None, None))
            elif role == SLAVE:
                out.append((key[0], message, role, WRONG_SIDE, None, None, None))
            elif role is None and (sites is None or not len(sites) or sites[0] != self.local):
                out.append((key[0], message, None, INVALID, None, None, None))
            else:
                role, last = MASTER, last + 1
                out.append((key[0], message, role, APPENDED, last, int(at), event))
        if role:
            self.about.update((role, last))
        yield pd.DataFrame(out, columns=["persistence_id", "message_nr", "role", "outcome", "sequence_nr", "timestamp_ms", "event"]).astype({"sequence_nr": "Int64", "timestamp_ms": "Int64"})

    def close(self) -> None:
        pass


OUTCOME_SCHEMA = "persistence_id string, message_nr long, role string, outcome string, sequence_nr long, timestamp_ms long, event string"


def replicate(messages: DataFrame, local: str, log: DataFrame | None = None) -> DataFrame:
    """What a site does with a stream of messages, one row for each reply or stored event; roles outlive restarts with the stream's checkpoint.

    messages: (persistence_id, message_nr, kind, sequence_nr, timestamp_ms, sites, event); a write
    gets the entity's next number. log is the stored log, read once when the stream first
    starts. Rows of one entity in one trigger go through one task, in order of message_nr.
    """
    start = None if log is None else by_history(log, local).groupBy("persistence_id")
    grouped = messages.groupBy("persistence_id")
    return grouped.transformWithStateInPandas(Entity(local), OUTCOME_SCHEMA, "Append", "None", initialState=start)
