"""Namespaces, depth and groups of schemas; backups by tag; stored logs; streams with replays, late rows and many parts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlake.operators import fold, log, runs
from eventlake.sources import chunks, framing, xsd
from eventlake.streaming import materialize as m
from eventlake.streaming import stateful as s

ENVELOPES = "persistence_id string, sequence_nr long, timestamp_ms long, event string"
HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" '
A = HEAD + """xmlns:a="urn:a" xmlns:b="urn:b" targetNamespace="urn:a"><xs:import schemaLocation="b"/><xs:element name="top"><xs:complexType><xs:sequence><xs:element name="x" type="a:T"/>
<xs:element name="y" type="b:T"/><xs:element ref="b:note" minOccurs="0" maxOccurs="9"/><xs:group ref="a:G"/></xs:sequence><xs:attributeGroup ref="a:AG"/></xs:complexType></xs:element>
<xs:complexType name="T"><xs:sequence><xs:element name="mine" type="xs:string"/></xs:sequence></xs:complexType><xs:group name="G"><xs:sequence><xs:element name="g" type="xs:int"/></xs:sequence></xs:group>
<xs:attributeGroup name="AG"><xs:attribute name="code"/></xs:attributeGroup></xs:schema>"""
B = HEAD + """targetNamespace="urn:b"><xs:element name="note" type="xs:string"/><xs:complexType name="T"><xs:sequence><xs:element name="other" type="xs:string"/></xs:sequence></xs:complexType></xs:schema>"""


def test_schema_names(spark):
    schema = xsd.load("a", {"a": A, "b": B}.__getitem__)
    assert schema.struct("top").simpleString() == "struct<x:struct<mine:string>,y:struct<other:string>,note:array<string>,g:string,code:string>"
    with pytest.raises(ValueError, match="defined twice"):
        xsd.load("a", {"a": A, "b": A.replace('"mine"', '"yours"').replace('<xs:import schemaLocation="b"/>', "")}.__getitem__)
    with pytest.raises(ValueError, match="note"):
        xsd.load("a", {"a": A, "b": B.replace('name="note"', 'name="no"')}.__getitem__)


def test_schema_depth(spark):
    inner = "<xs:element name='leaf' type='xs:string'/>"
    for i in range(9):
        inner = f"<xs:element name='e{i}'><xs:complexType><xs:sequence>{inner}</xs:sequence></xs:complexType></xs:element>"
    schema, _ = xsd.parse(HEAD + ">" + inner + "</xs:schema>")
    doc = "".join(f"<e{i}>" for i in range(8, -1, -1)) + "<leaf>z</leaf>" + "".join(f"</e{i}>" for i in range(9))
    row = spark.createDataFrame([(doc,)], "d string").select(xsd.xml_to_json(F.col("d"), schema, "e8").alias("j")).first()
    assert row.j == "".join(f'{{"e{i}":' for i in range(7, -1, -1)) + '{"leaf":"z"}' + "}" * 8
    tree, _ = xsd.parse(HEAD + '><xs:element name="n" type="N"/><xs:complexType name="N"><xs:sequence><xs:element name="n" type="N" minOccurs="0"/></xs:sequence></xs:complexType></xs:schema>')
    assert tree.struct("n", recursion=1).simpleString() == "struct<n:struct<n:string>>"


def test_backup_keeps_tags_apart(spark, tmp_path):
    rows = [(f"p{i % 3}", i, 1_000_000 + i * 1000, "A" if i < 5 else "B", f"e{i}".encode()) for i in range(10)]
    df = spark.createDataFrame(rows, "persistence_id string, sequence_nr long, timestamp_ms long, tag string, event binary")
    chunks.backup(df, f"{tmp_path}/b", 4)
    starts = lambda tag: sorted(r.start_ms for r in chunks.chunks(spark, f"{tmp_path}/b", tag, -1).collect())
    assert starts("A") == [1_000_000, 1_004_000] and starts("B") == [1_005_000, 1_009_000]
    assert chunks.restore(spark, f"{tmp_path}/missing", "A").collect() == []
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        chunks.backup_stream(stream(), f"{tmp_path}/s", f"{tmp_path}/cp", 4).awaitTermination(90)
    back = framing.decode_frames(chunks.restore(spark, f"{tmp_path}/s", "B"), "message")
    assert sorted(r.sequence_nr for r in back.collect()) == [5, 6, 7, 8, 9]


def test_stored_log_is_pruned(spark, tmp_path):
    day = 86_400_000
    df = spark.createDataFrame([("k", i, i * day // 2, "odd" if i % 2 else "even", "e") for i in range(20)], "persistence_id string, sequence_nr long, timestamp_ms long, tag string, event string")
    log.store(df, f"{tmp_path}/log")
    part = log.stored(spark, f"{tmp_path}/log", "odd", 3 * day, 5 * day)
    assert sorted(r.sequence_nr for r in part.collect()) == [7, 9]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan and "Window" not in plan and "GreaterThanOrEqual(timestamp_ms" in plan


def test_runs_through_a_target_and_chunks_by_time(spark):
    df = spark.createDataFrame([("k", i, v, "clash") for i, v in enumerate([1, -1, -2, 3, -4, 5])], "k string, i int, v int, opens string")
    merge = lambda d: d.groupBy("k", "run").agg(F.min("i").alias("i"), F.sum("v").cast("int").alias("v"), F.min("opens").alias("opens"))
    got = runs.run_targets(df, ["k"], ["i"], F.col("v") < 0, merge)
    assert [(r.i, r.v) for r in got.orderBy("i").collect()] == [(0, 1), (1, -3), (3, 3), (4, -4), (5, 5)]
    assert set(runs.chunk_by_weight(df.withColumn("own", F.lit(7)), ["i"], F.lit(1), 2).columns) == {"k", "i", "v", "opens", "own", "chunk"}
    times = spark.createDataFrame([("a", t) for t in (0, 10, 99, 100, 130, 131, 132, 133)] + [("b", 5)], "k string, t long")
    found = runs.chunk_within(times, ["k"], ["t"], "t", 3, 100)
    assert sorted((r.k, r.t, r.chunk) for r in found.collect()) == [("a", 0, 0), ("a", 10, 0), ("a", 99, 0), ("a", 100, 1), ("a", 130, 1), ("a", 131, 1), ("a", 132, 2), ("a", 133, 2), ("b", 5, 0)]
    total = fold.running(times, ["k"], ["t"], F.lit(1), "n").where("k = 'a'").orderBy("t").collect()
    assert [r.n for r in total] == list(range(1, 9))
    assert log.require_rows(times) is times


def test_throttle_of_a_hot_key(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("who"), (F.col("id") * 10).alias("t"))
    got = fold.throttle(df, "who", "t", 1, 100, 3).groupBy("granted").count().collect()
    assert {r.granted: r["count"] for r in got} == {True: 5002, False: 44_998}


def test_two_replays_and_late_rows(spark, tmp_path):
    rows = [("k", i, i * 1000, f"e{i}") for i in range(1, 7)]
    df, keys = spark.createDataFrame(rows, ENVELOPES), ["persistence_id", "sequence_nr"]
    apply = m.upsert_parquet(spark, f"{tmp_path}/out", keys)
    m.replay(df, apply, 0, 3000)
    m.replay(df, apply, 3000, 5000)
    m.replay(df, apply, 3000, 5000)
    m.reimport(df, spark.createDataFrame([("k",)], "persistence_id string"), apply, 12_000)
    add = lambda n, part: spark.createDataFrame(part, ENVELOPES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema(ENVELOPES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for n, part in enumerate(([("z", 9, 10_000_000, "new")], [("z", 1, 1, "very late"), ("z", 9, 10_000_000, "new")])):
        add(n, part)
        m.materialize(stream(), apply, f"{tmp_path}/cp").awaitTermination(90)
    got = sorted((r.persistence_id, r.sequence_nr, r.event) for r in m.merged(spark, f"{tmp_path}/out", keys).collect())
    assert got == [("k", 1, "e1"), ("k", 2, "e2"), ("k", 3, "e3"), ("k", 4, "e4"), ("z", 1, "very late"), ("z", 9, "new")]


def test_order_over_all_parts():
    parts = [pd.DataFrame({"n": [5, 3], "x": list("ec")}), pd.DataFrame({"n": [4, 1], "x": list("da")})]
    assert list(s.in_order(iter(parts), "n", "x")) == [(1, "a"), (3, "c"), (4, "d"), (5, "e")]
