"""Stateful stream operators: commands to events, gap-safe replicas, token buckets; one keyed processor each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(parts: Iterable[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """A key's new rows by their first column, over all the parts that they come in (commands: one trigger's rows of one key)."""
    whole = pd.concat(list(parts), ignore_index=True).sort_values(columns[0], kind="stable")
    yield from zip(*(whole[c].tolist() for c in columns))


@dataclass
class Results:
    """What a command leads to: an error, or no change with a reply, or events with a reply; in this order of precedence."""

    error: str | None = None
    applied: bool = False
    events: list[str] = field(default_factory=list)
    reply: str = ""


class Commands(StatefulProcessor):
    """Commands of one entity, one after the other, against its state; state is a text that ``apply(state, event)`` advances."""

    def __init__(self, handle: Callable[[str, str], Results], apply: Callable[[str, str], str], empty: str = ""):
        self.handle_command, self.apply, self.empty = handle, apply, empty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        state, last = self.state.get() if self.state.exists() else (self.empty, 0)
        out = []
        for nr, command in in_order(rows, "command_nr", "command"):
            r = self.handle_command(state, command)
            if r.error is not None:
                out.append((key[0], nr, "error", r.error, None, None))
            elif r.applied or not r.events:
                out.append((key[0], nr, "already applied" if r.applied else "ok", r.reply, None, None))
            else:
                for event in r.events:
                    state, last = self.apply(state, event), last + 1
                    out.append((key[0], nr, "ok", r.reply, last, event))
        self.state.update((state, last))
        yield pd.DataFrame(out, columns=["persistence_id", "command_nr", "outcome", "reply", "sequence_nr", "event"])

    def close(self) -> None:
        pass


RESULT_SCHEMA = "persistence_id string, command_nr long, outcome string, reply string, sequence_nr long, event string"


def run_commands(commands: DataFrame, handle: Callable[[str, str], Results], apply: Callable[[str, str], str]) -> DataFrame:
    """Replies and events of a stream of commands (persistence_id, command_nr, command)."""
    return commands.groupBy("persistence_id").transformWithStateInPandas(Commands(handle, apply), RESULT_SCHEMA, "Append", "None")


class Replica(StatefulProcessor):
    """Envelopes of one entity at a replica: appended in order, repeated ones acknowledged, early ones kept until the gap is filled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "nr long")
        self.waiting = handle.getMapState("waiting", "nr long", "timestamp_ms long, event string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        # part by part: what comes early waits in the state store, so a key's rows of one trigger never meet in memory
        for part in rows:
            out = []
            for nr, at, event in in_order([part], "sequence_nr", "timestamp_ms", "event"):
                if nr <= last:
                    out.append((key[0], nr, at, event, "duplicate"))
                elif nr > last + 1:
                    self.waiting.updateValue((nr,), (at, event))
                else:
                    out.append((key[0], nr, at, event, "appended"))
                    last = nr
                    while self.waiting.containsKey((last + 1,)):
                        at, event = self.waiting.getValue((last + 1,))
                        self.waiting.removeKey((last + 1,))
                        last += 1
                        out.append((key[0], last, at, event, "appended"))
            yield pd.DataFrame(out, columns=["persistence_id", "sequence_nr", "timestamp_ms", "event", "outcome"])
        self.last.update((last,))

    def close(self) -> None:
        pass


def replicate(envelopes: DataFrame) -> DataFrame:
    """What a replica does with each arriving envelope, as a stream; timestamps are the acknowledgements."""
    schema = "persistence_id string, sequence_nr long, timestamp_ms long, event string, outcome string"
    return envelopes.groupBy("persistence_id").transformWithStateInPandas(Replica(), schema, "Append", "None")
