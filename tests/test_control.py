"""Control tables, roles and progress of streams."""

import pytest
from pyspark.sql import functions as F

from eventlake.sources import control
from eventlake.streaming import materialize as m
from eventlake.streaming import progress, roles
from eventlake.tables import folder_names


@pytest.fixture
def table(spark, tmp_path):
    return control.ControlTable(spark, f"{tmp_path}/t", {"k": "string", "n": "int"}, {"v": "long", "top": "long", "sites": "array<string>"}, {"top": control.largest, "sites": control.united}, 8)


def rows(df):
    return sorted((r.k, r.n, r.v, r.top, r.sites) for r in df.collect())


def test_upserts(spark, table):
    assert table.read().collect() == [] and table.manifest() == (0, None, {})
    make = lambda data: spark.createDataFrame(data, "k string, n int, v long, top long, sites array<string>, at int, extra string")
    assert table.upsert(make([("a", 1, 5, 5, ["x"], 2, ""), ("a", 1, 4, 9, ["y", "x"], 1, ""), (None, 1, 1, 1, None, 1, ""), ("b", 2, None, None, None, 1, "")]), 3, F.col("at"))
    want = [("a", 1, 5, 9, ["x", "y"]), ("b", 2, None, None, [])]
    assert rows(table.read()) == want
    assert not table.upsert(make([("a", 1, 77, 77, ["z"], 1, "")]), 3) and not table.upsert(make([("a", 1, 77, 77, ["z"], 1, "")]), 2)
    assert rows(table.read()) == want
    table.upsert(make([("a", 1, 6, 6, ["z"], 1, "")]).select("n", "k", "v", "sites"), 4)
    assert rows(table.read()) == [("a", 1, 6, 9, ["x", "y", "z"]), want[1]]
    assert table.upsert(make([]), 5) and table.manifest()[1] == 5 and len(rows(table.read())) == 2
    found = table.lookup(make([("a", 1, 0, 0, None, 0, ""), ("c", 3, 0, 0, None, 0, "")]).select("k", "n"), v=0)
    assert rows(found) == [("a", 1, 6, 9, ["x", "y", "z"]), ("c", 3, 0, None, None)]


def test_a_batch_reads_only_its_buckets(spark, table):
    many = spark.range(200).selectExpr("cast(id as string) as k", "1 as n", "id as v")
    table.upsert(many)
    before = table.manifest()[2]
    assert len(before) == 8
    read = []
    inner, table._rows = table._rows, lambda versions: (read.append(set(versions)), inner(versions))[1]
    table.upsert(many.where("k = '7'").withColumn("v", F.lit(0)))
    table.lookup(many.where("k = '7'").select("k", "n")).collect()
    after = table.manifest()[2]
    changed = {b for b in after if after[b] != before[b]}
    assert len(changed) == 1 and read == [changed, changed]
    assert all(f"bucket={b}" in f for f in inner({b: after[b] for b in changed}).inputFiles() for b in changed)
    assert table.read().count() == 200 and table.read().where("v = 0").count() == 2


def test_unfinished_batches_and_expiry(spark, table):
    one = spark.createDataFrame([("a", 1, 1)], "k string, n int, v long")
    for number in range(4):
        table.upsert(one.withColumn("v", F.lit(number)), number)
    one.withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{table.path}/data/version=lost")  # no manifest tells of it
    assert [r[2] for r in rows(table.read())] == [3]
    assert table.expire() == 3 + 4
    assert [r[2] for r in rows(table.read())] == [3] and table.manifest()[:2] == (4, 3)
    assert len([n for n in folder_names(spark, f"{table.path}/manifest") if "=" in n]) == 1


SCHEMA = "persistence_id string, sequence_nr long, timestamp_ms long, event string"


def test_streams_keep_a_table_and_tell_their_progress(spark, tmp_path):
    def add(name, data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    view = control.ControlTable(spark, f"{tmp_path}/view", {"persistence_id": "string"}, {"sequence_nr": "long", "event": "string"}, buckets=4)
    recorder = progress.record(spark, f"{tmp_path}/progress", {"view": 5000})
    try:
        for name, data in (("a", [("x", 1, 1000, "one"), ("y", 1, 1500, "uno"), ("x", 2, 2000, "two")]), ("b", [("x", 3, 4000, "three")]), ("c", [])):
            add(name, data)
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            m.materialize(stream, view.apply(order=F.col("sequence_nr")), f"{tmp_path}/cp", name="view").awaitTermination(90)
        broken = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        with pytest.raises(Exception, match="no such"):
            m.materialize(broken, lambda batch, number: (_ for _ in ()).throw(ValueError("no such table")), f"{tmp_path}/cp2", name="broken").awaitTermination(90)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(recorder)
    assert sorted(tuple(r) for r in view.read().collect()) == [("x", 3, "three"), ("y", 1, "uno")]
    told = spark.read.parquet(f"{tmp_path}/progress")
    each = told.where("stream = 'view'").orderBy("batch").collect()
    assert [(r.batch, r.events, r.offset_ms, r.remaining_ms) for r in each] == [(0, 3, 2000, 3000), (1, 1, 4000, 1000)]
    assert all(r.delay_ms == r.at_ms - r.offset_ms and r.took_ms > 0 for r in each)
    now = {r.stream: r for r in progress.current(told).collect()}
    assert (now["view"].events, now["view"].offset_ms, now["view"].failures, now["view"].runs) == (4, 4000, 0, 2)
    assert now["broken"].failures == 1


def test_upsert_reads_buckets(spark, tmp_path):
    apply = m.upsert_parquet(spark, f"{tmp_path}/o", ["id"])
    apply(spark.range(500), 0)
    apply(spark.range(3), 1)
    apply(spark.range(498, 502), -5)
    apply(spark.range(498, 502), -5)
    back = m.merged(spark, f"{tmp_path}/o", ["id"])
    assert back.columns == ["id"] and sorted(r.id for r in back.collect()) == list(range(502))


MESSAGES = "persistence_id string, message_nr long, kind string, sequence_nr long, timestamp_ms long, sites array<string>, event string"
HISTORY = "persistence_id string, sequence_nr long, sites array<string>"


def test_roles_of_a_batch(spark):
    history = spark.createDataFrame([("old", 1, None), ("old", 2, []), ("m", 1, ["eu", "us"]), ("m", 2, ["us"]), ("s", 1, []), ("s", 2, ["us", "eu"])], HISTORY)
    told = [("read", None), ("write", ["us"]), ("write", None), ("event", ["eu"]), ("write", ["eu"]), ("read", None)]
    rows_ = [(k, n, kind, n, n, sites, "") for k in ("old", "m", "s", "new") for n, (kind, sites) in enumerate(told)] + [("w", 1, "write", 1, 1, ["eu"], ""), ("w", 2, "event", 1, 1, ["us"], "")]
    got = roles.outcomes(history, spark.createDataFrame(rows_, MESSAGES), "eu")
    by = {}
    for r in got.orderBy("message_nr").collect():
        by.setdefault(r.persistence_id, []).append((r.role, r.outcome))
    master = [("master", "ok")] * 3 + [("master", "wrong side")] + [("master", "ok")] * 2
    assert by["old"] == by["m"] == master
    assert by["s"] == [("slave", "ok"), ("slave", "wrong side"), ("slave", "wrong side"), ("slave", "ok"), ("slave", "wrong side"), ("slave", "ok")]
    assert by["new"] == [(None, "not found"), (None, "invalid first event"), (None, "invalid first event"), ("slave", "ok"), ("slave", "wrong side"), ("slave", "ok")]
    assert by["w"] == [("master", "ok"), ("master", "wrong side")]
    assert [tuple(r) for r in roles.migrations(history, "eu").collect()] == [("old", 3, ["eu"])]
    done = history.unionByName(roles.migrations(history, "eu"))
    assert roles.migrations(done, "eu").collect() == [] and {r.role for r in roles.by_history(done, "eu").collect()} == {"master", "slave"}


def test_roles_outlive_restarts(spark, tmp_path):
    history = spark.createDataFrame([("m", 1, ["eu"]), ("s", 1, ["us"]), ("s", 2, None), ("old", 4, None)], HISTORY)

    def run(name, data):
        spark.createDataFrame(data, MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(MESSAGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        done = roles.replicate(stream, "eu", history).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        done.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        return {(r.persistence_id, r.message_nr, r.sequence_nr): (r.role, r.outcome, r.event) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    first = [
        ("m", 1, "write", None, 10, ["eu"], "w"), ("m", 2, "event", 3, 10, ["us"], "e"), ("s", 1, "event", 4, 10, None, "four"), ("s", 2, "write", None, 10, None, "w"), ("s", 3, "event", 2, 10, None, "two"),
        ("old", 1, "write", None, 10, None, "w"), ("n", 1, "read", None, None, None, None), ("n", 2, "event", 1, 10, ["us"], "one"), ("v", 1, "write", None, 1, ["us"], "w"),
    ]
    got = run("a", first)
    assert got == {
        ("m", 1, 2): ("master", "appended", "w"), ("m", 2, None): ("master", "wrong side", None), ("s", 2, None): ("slave", "wrong side", None), ("s", 3, 2): ("slave", "duplicate", "two"),
        ("old", 1, 5): ("master", "appended", "w"), ("n", 1, None): (None, "not found", None), ("n", 2, 1): ("slave", "appended", "one"), ("v", 1, None): (None, "invalid first event", None),
    }
    again = run("b", [("s", 4, "event", 3, 10, None, "three"), ("n", 3, "write", None, 10, ["eu"], "w"), ("n", 4, "read", None, None, None, None), ("v", 2, "write", None, 1, ["eu"], "w"), ("m", 3, "write", None, 11, None, "x")])
    assert {k: v for k, v in again.items() if k not in got} == {
        ("s", 4, 3): ("slave", "appended", "three"), ("s", 4, 4): ("slave", "appended", "four"), ("n", 3, None): ("slave", "wrong side", None), ("n", 4, None): ("slave", "ok", None),
        ("v", 2, 1): ("master", "appended", "w"), ("m", 3, 3): ("master", "appended", "x"),
    }
