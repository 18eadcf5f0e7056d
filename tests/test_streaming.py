"""Streams: restart from a checkpoint, duplicates, keyed processors."""

import pytest

from eventlake.streaming import materialize as m
from eventlake.streaming import stateful as s

SCHEMA = "persistence_id string, sequence_nr long, timestamp_ms long, event string"


@pytest.fixture
def source(spark, tmp_path):
    def add(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    return add, lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), str(tmp_path)


def test_materialize_restarts(spark, source):
    add, stream, tmp = source
    apply = m.upsert_parquet(spark, f"{tmp}/out", ["persistence_id", "sequence_nr"])
    add("a", [("k", 1, 1000, "a"), ("k", 2, 2000, "b"), ("k", 2, 2000, "b")])
    m.materialize(stream(), apply, f"{tmp}/cp").awaitTermination(60)
    add("b", [("k", 3, 3000, "c"), ("k", 1, 1000, "a")])
    m.materialize(stream(), apply, f"{tmp}/cp").awaitTermination(60)
    got = sorted((r.sequence_nr, r.event) for r in spark.read.parquet(f"{tmp}/out").collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_replay_and_reimport(spark):
    log = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 20, "y"), ("a", 2, 90_000, "z")], SCHEMA)
    seen = []
    keep = lambda df, n: seen.extend((r.persistence_id, r.sequence_nr) for r in df.collect())
    m.replay(log, keep, 15, 90_000)
    m.reimport(log, spark.createDataFrame([("a",)], "persistence_id string"), keep, 95_000)
    assert seen == [("b", 1), ("a", 1)]


def test_replica_stream(spark, source):
    add, stream, tmp = source
    add("a", [("k", 1, 1000, "one"), ("k", 3, 3000, "three"), ("k", 1, 1000, "again")])
    run = lambda: s.replicate(stream()).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    run()
    add("b", [("k", 2, 2000, "two")])
    run()
    got = sorted((r.outcome, r.sequence_nr, r.event) for r in spark.read.parquet(f"{tmp}/out").collect())
    assert [g[:2] for g in got] == [("appended", 1), ("appended", 2), ("appended", 3), ("duplicate", 1)]


def test_commands(spark, tmp_path):
    def handle(state, command):
        if command == "bad":
            return s.Results(error="not allowed")
        if command in state.split(","):
            return s.Results(applied=True, reply="known")
        return s.Results(events=[command], reply="done")

    spark.createDataFrame([("k", 1, "x"), ("k", 2, "bad"), ("k", 3, "x"), ("k", 4, "y")], "persistence_id string, command_nr long, command string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("persistence_id string, command_nr long, command string").parquet(f"{tmp_path}/in")
    done = s.run_commands(stream, handle, lambda state, event: f"{state},{event}")
    done.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(90)
    got = [(r.command_nr, r.outcome, r.reply, r.sequence_nr, r.event) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("command_nr").collect()]
    assert got == [(1, "ok", "done", 1, "x"), (2, "error", "not allowed", None, None), (3, "already applied", "known", None, None), (4, "ok", "done", 2, "y")]
