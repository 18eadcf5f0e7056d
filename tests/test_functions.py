"""Scalar functions against Python's own and fixed examples."""

import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.functions import identifiers as ids
from eventlake.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_named_uuids(spark):
    names = ["", "a", "actor:token", "ü漢"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.u for r in df.select(ids.uuid_v5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


@given(st.integers(0, 4_102_444_800_000))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_time_uuids(spark, ms):
    got = one(spark, ids.uuid_start_of(F.col("ms")), ms=ms)
    assert uuid.UUID(got).version == 1 and uuid.UUID(got).time == (ms + ids.GREGORIAN_MS) * 10_000
    assert one(spark, ids.uuid_timestamp(F.col("u")), u=got) == ms


def test_time_of_another_version_is_an_error(spark):
    with pytest.raises(Exception, match="time-based"):
        one(spark, ids.uuid_timestamp(F.col("u")), u=str(uuid.uuid4()))


def java(s):
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (31 * h + int.from_bytes(raw[i : i + 2])) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=20))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_java_hash(spark, s):
    assert one(spark, ids.java_hash(F.col("s")), s=s) == java(s)


def test_chunk_keys(spark):
    key = one(spark, ids.chunk_key(F.lit("Order"), F.col("ms")), ms=1_650_000_000_500)
    assert key == "Order-from-2022_04_15_05_20_00_500"
    assert one(spark, ids.chunk_start(F.col("k")), k=key) == 1_650_000_000_500
    with pytest.raises(Exception, match="no start time"):
        one(spark, ids.chunk_start(F.col("k")), k="Order")


def test_times_tags_and_sets(spark):
    assert one(spark, ids.to_millis(F.col("s")), s="12") == 12
    assert one(spark, ids.to_millis(F.col("s")), s="1970-01-01T00:00:01Z") == 1000
    with pytest.raises(Exception, match="not a time"):
        one(spark, ids.to_millis(F.col("s")), s="soon")
    assert one(spark, ids.event_tag(F.col("s"), {"a.B": "bee"}), s="a.B") == "bee"
    assert one(spark, ids.event_tag(F.col("s"), {}), s="a.b.C") == "C"
    assert one(spark, ids.uuid_set(F.col("s")), s="b, a,b,") == ["a", "b"]


def test_base64(spark):
    assert one(spark, tx.base64_line(F.encode("s", "UTF-8")), s="hello there") == "aGVsbG8gdGhlcmU="
    assert bytes(one(spark, tx.base64_bytes(F.col("s")), s="aGVs bG8g\ndGhlcmU=")) == b"hello there"
    assert one(spark, tx.base64_bytes(F.col("s")), s="aGVsbG=") is None
    assert "\n" not in one(spark, tx.base64_line(F.encode("s", "UTF-8")), s="x" * 200)


def test_patterns(spark):
    assert one(spark, tx.full_match(F.col("s"), "a(b+)", 1), s="abb") == "bb"
    assert one(spark, tx.full_match(F.col("s"), "a(b+)", 1), s="abbc") is None
    with pytest.raises(Exception, match="should match"):
        one(spark, tx.must_match(F.col("s"), "a|b"), s="ab")
    value, error = tx.parsed(F.col("s"), "int", F.lit("row 3"))
    assert one(spark, F.struct(value.alias("v"), error.alias("e")), s="x").e == "Expecting int but was x at row 3"


def test_charsets(spark):
    assert one(spark, tx.decode_strict(tx.encode_strict(F.col("s"), "UTF-8"), "UTF-8"), s="ü漢🙂") == "ü漢🙂"
    with pytest.raises(Exception):
        one(spark, tx.decode_strict(F.unhex(F.col("s")), "UTF-8"), s="C3")
