"""Runs, chunks, folds and replicas on the small examples that fix their meaning."""

import pytest
from pyspark.sql import functions as F

from eventlake.operators import fold, log, runs, visibility


def ints(spark, values):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v int")


def test_group_while(spark):
    df = runs.group_while(ints(spark, [1, 2, 2, 2, 3, 2, 4, 4]), ["k"], ["i"], F.col("v") == F.col("prev.v"))
    got = [r.vs for r in df.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs")).orderBy("run").collect()]
    assert [[x.v for x in g] for g in got] == [[1], [2, 2, 2], [3], [2], [4, 4]]
    assert runs.limited_runs(df, ["k"], 3).count() == 5
    with pytest.raises(Exception, match="more than 2"):
        runs.limited_runs(df, ["k"], 2).collect()
    assert runs.group_while(ints(spark, []), ["k"], ["i"], F.lit(True)).count() == 0


def test_drop_until_next(spark):
    left = lambda values, at, keep: [r.v for r in runs.drop_until_next(ints(spark, values), ["k"], "i", F.col("v") >= at, keep).orderBy("i").collect()]
    values = [*range(1, 11), *range(9, 0, -1)]
    assert left(values, 5, False) == [4, *values[4:]]
    assert left([7, 1], 5, False) == [7, 1]
    assert left([1, 2, 3], 5, False) == [] and left([1, 2, 3], 5, True) == [3]


@pytest.mark.parametrize("parts", [1, 5])
def test_chunks_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(parts)
    got = runs.chunk_by_count(df, ["id"], 64).collect()
    assert all(r.chunk == r.id // 64 for r in got) and len(got) == 1000
    weighed = runs.chunk_by_weight(df, ["id"], F.lit(3), 10).collect()
    assert all(r.chunk == ((r.id + 1) * 3 - 1) // 10 for r in weighed)


def test_throttle(spark):
    at = [0, 0, 0, 0, 0, 0, 2500]
    df = spark.createDataFrame([("a", t) for t in at] + [("b", 0)], "who string, t long")
    got = sorted((r.who, r.t, r.granted) for r in fold.throttle(df, "who", "t", 3, 2000, 5).collect())
    assert [g for _, t, g in got if t == 0][:6].count(True) == 5
    assert ("a", 2500, True) in got and ("b", 0, True) in got


def test_acl(spark):
    rows = [("r", "u1", True, 1), ("r", "u1", False, 2), ("r", "u2", True, 3), ("w", "g", True, 1), ("w", "u2", True, 2)]
    rights = fold.acl(spark.createDataFrame(rows, "right string, target string, granted boolean, order int"))
    assert {tuple(r) for r in rights.collect()} == {("r", "u2"), ("w", "g"), ("w", "u2")}
    assert [tuple(r) for r in fold.sole_owners(rights).collect()] == [("r", "u2")]
    users = spark.createDataFrame([("u9", ["g"]), ("u2", None)], "user string, groups array<string>")
    assert {tuple(r) for r in fold.is_granted(rights, users).collect()} == {("u9", "w"), ("u2", "r"), ("u2", "w")}


def envelopes(spark, rows):
    return spark.createDataFrame(rows, "persistence_id string, sequence_nr long, timestamp_ms long, event string")


def test_replica(spark):
    stored = envelopes(spark, [("k", 1, 1000, "first")])
    again = envelopes(spark, [("k", 1, 1000, "other"), ("k", 3, 3000, "third")])
    done, waiting = visibility.apply_replica(stored, again)
    assert [r.event for r in done.collect()] == ["first"] and [r.sequence_nr for r in waiting.collect()] == [3]
    done, waiting = visibility.apply_replica(done, waiting.union(envelopes(spark, [("k", 2, 2000, "second")])))
    assert [r.event for r in done.orderBy("sequence_nr").collect()] == ["first", "second", "third"] and waiting.count() == 0


def test_forward(spark):
    history = envelopes(spark, [("a", 1, 1, "dc:eu"), ("a", 2, 2, "x"), ("a", 3, 3, "dc:us"), ("b", 1, 1, "dc:us"), ("b", 2, 4, "x"), ("c", 1, 1, "dc:eu"), ("c", 2, 5, "dc:*")])
    site = lambda d: visibility.classify(d, F.when(F.col("event").startswith("dc:"), F.array(F.substring("event", 4, 9))), "eu")
    before, after = site(history.where("timestamp_ms < 3")), site(history)
    sent = visibility.forward(history, history.where("timestamp_ms >= 3"), before, after, "us")
    assert sorted((r.persistence_id, r.sequence_nr) for r in sent.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("c", 1), ("c", 2)]


def test_log_edges(spark):
    rows = envelopes(spark, [("a", 1, 1, "x"), ("a", 1, 1, "x"), ("a", 3, 3, "y"), ("b", 2, 1, "z")])
    assert sorted((r.persistence_id, r.sequence_nr) for r in log.contiguous_prefix(rows).collect()) == [("a", 1)]
    assert log.deduplicated(rows).count() == 3
    assert fold.latest_state(rows, ["event"]).where("persistence_id = 'a'").first().event == "y"
