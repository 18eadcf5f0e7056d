"""Edge cases of CSV records and JSON documents, with values of our own."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.operators.fold import Fold
from eventlake.sources import csv_codec as c
from eventlake.sources import json_codec as j

#: Records with a comma as separator, and their cells ("" is an empty one).
RECORDS = {
    " ": [" "], "k": ["k"], "k,": ["k", ""], ",k": ["", "k"], ",": ["", ""], ",,,": ["", "", "", ""], "k,m": ["k", "m"], "k,,m": ["k", "", "m"], "": [""],
    '""': [""], '"",""': ["", ""], '","': [","], '",",","': [",", ","], 'k,"",m': ["k", "", "m"], ',""': ["", ""], '""""': ['"'], '"""",""': ['"', ""],
    'k,"""""",m': ["k", '""', "m"], 'k,"""v""",m': ["k", '"v"', "m"], 'k,"""v"': ["k", '"v'], 'k,"v"""': ["k", 'v"'], 'k,"""",m': ["k", '"', "m"],
    'k,"\n",m': ["k", "\n", "m"], 'k,"\r\n",m': ["k", "\r\n", "m"], 'k,"\r",m': ["k", "\r", "m"], 'k,"\r\n\r",m': ["k", "\r\n\r", "m"], 'k,"\nv"""': ["k", '\nv"'],
    '"""\n","""\n"': ['"\n', '"\n'], '"""\r","""\r"': ['"\r', '"\r'], '"\r\n,"': ["\r\n,"], '"\r\n,",': ["\r\n,", ""], 'k,"""\nv\n"""': ["k", '"\nv\n"'],
    'k,"one,two,three","m"': ["k", "one,two,three", "m"], ";": [";"], ";,;": [";", ";"], "\t,\t": ["\t", "\t"], "k\r,m": ["k\r", "m"], 'k,"open': ["k", "open"], "﻿k,m": ["k", "m"], 'k"x,m': ['k"x', "m"],
}


def test_csv_records(spark):
    comma = c.CsvSettings(separator=",")
    df = spark.createDataFrame([(t,) for t in RECORDS], "t string")
    got = {r.t: r.x for r in df.select("t", c.cells(F.col("t"), comma).alias("x"), c.misquoted(F.col("t"), comma).alias("wrong")).where("wrong is null").collect()}
    assert got == {t: [x or None for x in cells] for t, cells in RECORDS.items()}
    many = ",".join(['"a""b"'] * 20_000)
    odd = spark.createDataFrame([("|", "a|b|c"), (".", "ab.c"), ("^", "a^b"), ("\\", "a\\b"), (",", '"a"b,c'), (",", many), (",", '"' + '""' * 50_000 + '"')], "sep string, t string").collect()
    for r in odd:
        row = spark.createDataFrame([r]).select(c.cells(F.col("t"), c.CsvSettings(separator=r.sep)).alias("x"), c.misquoted(F.col("t"), c.CsvSettings(separator=r.sep)).alias("w")).first()
        want = {"a|b|c": ["a", "b", "c"], "ab.c": ["ab", "c"], "a^b": ["a", "b"], "a\\b": ["a", "b"], '"a"b,c': ["a", "c"], many: ['a"b'] * 20_000}.get(r.t, ['"' * 50_000])
        assert row.x == want and (row.w is not None) == (r.t == '"a"b,c')


def test_csv_documents(spark):
    text = 'name;n\n"x;\ny";1\r\n\n"q""";2\n'
    got = spark.createDataFrame([(text,)], "t string").select(c.records(F.col("t")).alias("r")).first().r
    assert got == [["name", "n"], ["x;\ny", "1\r"], [None], ['q"', "2"], [None]]
    df = spark.createDataFrame([('"a"b;1',), ("z" * 11 + ";2",), ("k;3",), (None,)], "t string")
    found = c.decode(df, "t", ["name", "n", "name"], {"name": "string", "n": "int"}, settings=c.CsvSettings(longest_cell=10)).collect()
    assert [r.error is None for r in found] == [False, False, True] and found[2].name == "k"


def test_one_header_for_all_files(spark, tmp_path):
    df = spark.range(6).repartition(3).select("id", F.col("id").cast("string").alias('na"me'))
    c.write_csv(df, f"{tmp_path}/c", each_file=False)
    lines = [x for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == '"id";"na""me"' and len(lines) == 7
    c.write_csv(df.limit(0), f"{tmp_path}/none", each_file=False)
    assert all(f.read_text() == "" for f in (tmp_path / "none").glob("part-*"))


def values(spark, protocol, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    value, error = j.decoded(F.col("t"), protocol)
    return [(r.v, r.e) for r in df.select(value.alias("v"), error.alias("e")).collect()]


def test_json_repeated_fields_and_roots(spark):
    one = j.Object({"a": j.Scalar("int")})
    got = values(spark, one, '{"a":1,"a":2}', "5", "[1]", '"x"', "null", ' {"a":"3"}', "{")
    assert [v.a if v else None for v, _ in got] == [2, None, None, None, None, 3, None]
    assert [e for _, e in got[:7]] == [None] * 6 + ["not JSON"]
    assert values(spark, j.AnyField(j.Scalar("int")), '{"k":1,"m":5,"k":2}')[0][0] == {"m": 5, "k": 2}
    assert values(spark, j.Each(j.Scalar("int")), '[1,null,"3"]', "{}", "[]") == [([1, 3], None), (None, None), ([], None)]
    assert values(spark, j.Scalar("boolean"), "true", "false")[0][0] is True


def test_json_defaults_checks_and_writing(spark):
    proto = j.Object({"a": j.Scalar("int").map(lambda v: v * 2, lambda v: F.when(v < 0, F.lit("negative"))), "b": j.Scalar("string")}, optional=("b",), defaults={"b": "none"})
    got = values(spark, proto, '{"a":4}', '{"a":-1,"b":"x"}')
    assert got[0][0].asDict() == {"a": 8, "b": "none"} and got[1] == (None, "negative at $.a")
    row = spark.sql("select named_struct('a', 1, 'b', cast(null as int), 'c', array(), 'd', array(1)) as v, named_struct('a', cast(null as int)) as w")
    out = row.select(j.write(F.col("v"), {"kind": "x"}, ("c", "d")).alias("v"), j.write(F.col("w"), {"kind": "x"}).alias("w")).first()
    assert out.v == '{"kind":"x","a":1,"d":[1]}' and out.w == '{"kind":"x"}'


def test_json_streams_of_elements(spark):
    df = spark.createDataFrame([('{"xs":[{"n":1},{"m":0},{"n":2}]}',), ("{}",), (None,)], "t string")
    item = j.Object({"n": j.Scalar("int")})
    assert [r.element.n for r in j.elements(df, "t", "xs", item).collect()] == [1, 2]
    total = Fold(F.lit(0), lambda s, e: s + e["n"])
    value, _ = j.decoded(F.col("t"), j.Object({"xs": j.Each(item)}))
    assert df.select(total.over(value["xs"]).alias("s")).first().s == 3
    first = lambda t: spark.createDataFrame([(t,)], "t string").select(j.first_of(F.col("t"), item).alias("v")).first().v
    assert first('[{"m":0},{"n":7},{"n":8}]').n == 7 and first('{"n":9}').n == 9
    with pytest.raises(Exception, match="no element"):
        first("[]")


def test_json_by_kind(spark):
    one = j.Object({"a": j.Scalar("string"), "n": j.Scalar("int"), "[k": j.Scalar("int")}, optional=("n", "[k"))
    got = values(
        spark, one, '{"a":{"b":1}}', '{"a":[1]}', '{"a":"{b"}', '{"a":"[","n":{}}', '{"a":1} x', '{"a":1}]', '{"a":1},{"a":2}', "{'a':1}", '{"a":"x\\"{y"}', '{"a":"1","n":[2]}', '{"a":"","[k":4}', '{"a":1,"n":"[3"}', "", " "
    )
    assert [v.a if v else None for v, _ in got] == [None, None, "{b", "[", None, None, None, None, 'x"{y', "1", "", None, None, None]
    assert [e for _, e in got] == [None] * 4 + ["not JSON"] * 4 + [None] * 3 + ["Expecting int but was [3 at $.n"] + ["not JSON"] * 2
    assert got[10][0]["[k"] == 4
    assert values(spark, j.AnyField(j.Scalar("string")), '{"[x":"{y","o":{},"z":"1"}')[0][0] == {"[x": "{y", "z": "1"}
    assert values(spark, j.Object({"v": j.Scalar("int")}, having={"n": 1}), '{"n":{},"v":3}', '{"n":1,"v":3}')[0] == (None, "must have n = 1 but was absent at $")
    assert values(spark, j.Scalar("decimal(38,0)"), "12345678901234567890123456789012345678")[0][0] == 12345678901234567890123456789012345678
    assert values(spark, j.Typed("struct<a:string>"), '{"a":"[b"}')[0][0].a == "[b"


def test_json_paths_and_effects(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"x":{"p":[{"n":1},{"n":2}],"q":[{"n":3},5]}}'), (2, '{"x":[]}'), (3, None)], "_part int, t string")
    found = j.elements(df, "t", ["x", j.ANY, j.EACH, "n"], j.Scalar("int"), "n")
    assert [tuple(r) for r in found.select("_part", "n").collect()] == [(1, 1), (1, 2), (1, 3)]
    path = str(tmp_path)

    def note(row):
        with open(f"{path}/{row.n}", "w") as f:
            f.write(str(row._part))

    j.for_each(found, note)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"1": "1", "2": "1", "3": "1"}
    with pytest.raises(Exception, match="not JSON"):
        j.elements(df.withColumn("t", F.lit("{")), "t", "x", j.Scalar("int")).collect()


def test_json_trees_are_checked():
    many = j.Many(j.Scalar("int"))
    for wrong in (lambda: j.Object({"a": many}), lambda: j.AnyField(many), lambda: j.Each(j.Each(many).inner) and j.Object({"b": many}), lambda: j.decoded(F.lit(""), many)):
        with pytest.raises(TypeError, match="Each"):
            wrong()
    with pytest.raises(TypeError, match="constants"):
        j.Object({"a": j.Scalar("int")}, having={"a": "1"})
    assert j.Object({"a": j.Each(many)}).schema() == "struct<`a`:array<string>>"


TEXT = st.text(alphabet='ab{}[]",:\\ é\n1', max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXT, st.none() | st.integers(-9, 1 << 62), st.lists(TEXT, max_size=3), st.dictionaries(TEXT, st.integers(0, 9), max_size=3), st.booleans()), min_size=1, max_size=20))
def test_writing_what_was_read(spark, rows):
    tree = j.Object(
        {"s": j.Scalar("string"), "n": j.Scalar("bigint"), "xs": j.Each(j.Scalar("string").map(F.reverse, back=F.reverse)), "m": j.AnyField(j.Scalar("int")), "b": j.Scalar("boolean")},
        optional=("n", "xs", "m"), having={"k": 'c"{'},
    )
    df = spark.createDataFrame([((s, n, xs, m, b),) for s, n, xs, m, b in rows], "v struct<s:string,n:bigint,xs:array<string>,m:map<string,int>,b:boolean>")
    text = df.select("v", j.encoded(F.col("v"), tree).alias("t"))
    back, error = j.decoded(F.col("t"), tree)
    for r in text.select("v", back.alias("back"), error.alias("e"), j.encoded(back, tree).alias("again"), "t").collect():
        want = r.v.asDict()
        assert r.e is None and r.back.asDict() | {"m": r.back.m or {}} == want | {"m": want["m"] or {}}
        assert json.loads(r.t) == json.loads(r.again)
