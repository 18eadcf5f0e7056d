"""Codecs: examples of reading, writing and their errors."""

import pytest
from pyspark.sql import functions as F

from eventlake.sources import chunks, csv_codec, framing, xsd
from eventlake.sources.json_codec import AnyField, Each, Object, Scalar, any_of, combined, decoded, read, write

BOX = Object({"weight": Scalar("bigint"), "floor": Scalar("int"), "labels": Each(Scalar("string"))}, optional=("floor",))


def values(spark, protocol, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    value, error = decoded(F.col("t"), protocol)
    return [(r.v, r.e) for r in df.select(value.alias("v"), error.alias("e")).collect()]


def test_json_objects(spark):
    found = values(spark, BOX, '{"weight":900,"floor":"3","labels":["heavy","glass"]}', '{"weight":"15"}', '{"floor":2}', '{"weight":"much"}', "{", None)
    assert found[0][0].asDict() == {"weight": 900, "floor": 3, "labels": ["heavy", "glass"]}
    assert found[1][0].asDict() == {"weight": 15, "floor": None, "labels": []}
    assert found[2] == (None, None)
    assert found[3] == (None, "Expecting bigint but was much at $.weight")
    assert found[4] == (None, "not JSON") and found[5] == (None, None)
    df = spark.createDataFrame([('{"floor":2}',), ('{"weight":8}',), ("{",)], "t string")
    assert read(df, "t", BOX).count() == 2


def test_json_collections(spark):
    assert values(spark, Object({"a": Each(Each(Scalar("int")))}), '{"a":[[1,2],[3,4]]}')[0][0].a == [[1, 2], [3, 4]]
    assert values(spark, AnyField(Scalar("string")), '{"red":"rot","blue":"blau"}')[0][0] == {"red": "rot", "blue": "blau"}
    assert values(spark, AnyField(Each(Scalar("int"))), '{"odd":[9,7],"even":[]}')[0][0] == {"odd": [9, 7], "even": []}


def test_json_alternatives(spark):
    one = Object({"d": Scalar("int")}, having={"alternative": "1"}).map(lambda v: v["d"])
    two = Object({"i": Scalar("int")}, having={"alternative": "2"}).map(lambda v: v["i"])
    df = spark.createDataFrame([('{"alternative":1,"d":5}',), ('{"alternative":"2","i":6}',), ('{"alternative":"3"}',)], "t string")
    value, error = any_of(F.col("t"), one, two)
    got = df.select(value.alias("v"), error.alias("e"), combined(F.col("t"), one, two).alias("all")).collect()
    assert [r.v for r in got] == [5, 6, None] and got[0].e is None and ", alternatively " in got[2].e
    assert [r["all"] for r in got] == [[5], [6], []]
    assert spark.range(1).select(write(F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))).alias("j")).first().j == '{"a":1}'


def test_csv(spark):
    df = spark.createDataFrame([('"pear";"31"',), ("plum;8",), ('"a ""q"";b";7',), ("fig",), (';"5"',), ("nut;few",)], "line string")
    got = csv_codec.decode(df, "line", ["fruit", "count"], {"fruit": "string", "count": "int", "gone": "int"}, optional=("count", "gone")).collect()
    assert [tuple(r[c] for c in ("fruit", "count", "error")) for r in got] == [("pear", 31, None), ("plum", 8, None), ('a "q";b', 7, None), ("fig", None, None), ("nut", None, "Expecting int in count but was few")]
    assert csv_codec.decode(df, "line", ["fruit", "count"], {"fruit": "string", "count": "int"}).count() == 4
    line = spark.createDataFrame([('a"b', None, "")], "x string, y int, z string").select(csv_codec.line([F.col("x"), F.col("y"), F.col("z")]).alias("l")).first().l
    assert line == '"a""b";;'


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a\nb;", 1), ('q"', 2)], "t string, n int").coalesce(1)
    csv_codec.write_csv(df, f"{tmp_path}/c")
    back = csv_codec.read_csv(spark, f"{tmp_path}/c", "t string, n int")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_framing():
    assert list(framing.frames(bytes([4, 0, 0, 0, 0, 2, 1, 1]))) == [b"\0\0\0\0", b"\1\1"]
    for wrong in (bytes([0xFF] * 10), bytes([5, 1]), bytes([0x80])):
        with pytest.raises(ValueError):
            list(framing.frames(wrong))
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert framing.read_varint(framing.varint(n), 0) == (n, len(framing.varint(n)))
    assert framing.decode_envelope(framing.encode_envelope("é", 3, 1 << 41, b"\0x")) == ("é", 3, 1 << 41, b"\0x")
    for n in (-1, -(1 << 63), (1 << 63) - 1):
        assert framing.decode_envelope(framing.encode_envelope("k", n, -n - 1, b""))[1:3] == (n, -n - 1)


def test_streams_cut_at_every_byte(spark):
    """The same messages come out wherever a stream is cut: in a length, in a message, between two."""
    sent = [(f"k{i}", i, -i, b"x" * n) for i, n in enumerate((0, 1, 3, 130, 0, 127, 20_000))]
    whole = b"".join(framing.varint(len(m)) + m for m in (framing.encode_envelope(*e) for e in sent))
    for at in [*range(420), *range(len(whole) - 5, len(whole))]:
        d = framing.Deframer()
        assert [framing.decode_envelope(m) for part in (whole[:at], whole[at:]) for m in d.feed(part)] == sent
        d.end()
    one = framing.Deframer()
    assert [framing.decode_envelope(m) for i in range(600) for m in one.feed(whole[i : i + 1])] == sent[:6]
    with pytest.raises(ValueError, match="within a message"):
        one.end()
    with pytest.raises(ValueError, match="malformed"):
        list(framing.Deframer().feed(b"\xff" * 10))
    rows = [(s, n, whole[i : i + size]) for s, size in (("a", 100), ("b", 7001)) for n, i in enumerate(range(0, len(whole), size))] + [("a", 10**6, None), ("c", 0, b""), (None, 0, whole)]
    df = spark.createDataFrame(rows, "name string, n int, content binary").orderBy(F.rand(3))
    got = framing.decode_chunks(df, "name", "n", rows=2).orderBy("name", "place").collect()
    assert [(r.name, r.place, r.persistence_id, r.sequence_nr, r.timestamp_ms, bytes(r.event)) for r in got] == [(s, i, *e) for s in "ab" for i, e in enumerate(sent)]
    assert {r.name: r.content and bytes(r.content) for r in framing.concatenated(df, ["name"], "n").collect()} == {"a": whole, "b": whole, "c": b"", None: whole}
    with pytest.raises(Exception, match="within a message"):
        framing.decode_chunks(df.where("n < 1 and name is not null"), "name", "n").collect()


def test_null_parts_of_envelopes(spark):
    df = spark.createDataFrame([(None, None, -5, None), ("k", (1 << 53) + 1, None, b"e")], "p string, n long, t long, e binary")
    back = framing.decode_frames(df.select(framing.envelope_frame("p", "n", "t", "e").alias("content"))).collect()
    assert sorted((r.persistence_id, r.sequence_nr, r.timestamp_ms, bytes(r.event)) for r in back) == [("", 0, -5, b""), ("k", (1 << 53) + 1, 0, b"e")]


def test_backup_and_restore(spark, tmp_path):
    rows = [("p", i, 1_650_000_000_500 + i * 1000, "T", f"e{i}".encode()) for i in range(1, 8)] + [("q", 1, 1, "U", b"u")]
    log = spark.createDataFrame(rows, "persistence_id string, sequence_nr long, timestamp_ms long, tag string, event binary")
    chunks.backup(log, f"{tmp_path}/b", 3)
    kept = chunks.chunks(spark, f"{tmp_path}/b", "T").orderBy("start_ms").collect()
    assert [r.start_ms for r in kept][0] == 1_650_000_001_500 and len(kept) == 3
    later = chunks.restore(spark, f"{tmp_path}/b", "T", 1_650_000_005_500)
    back = framing.decode_frames(later, "message").orderBy("sequence_nr").collect()
    assert [r.sequence_nr for r in back][-1] == 7 and [r.sequence_nr for r in back][0] in (3, 4) and bytes(back[-1].event) == b"e7"
    assert [r.start_ms for r in chunks.chunks(spark, f"{tmp_path}/b", "T", 1 << 60).collect()] == [kept[-1].start_ms]


MAIN = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:c="urn:c" targetNamespace="urn:m"><xs:import namespace="urn:c" schemaLocation="common.xsd"/>
<xs:element name="person" type="Person"/><xs:complexType name="Person"><xs:complexContent><xs:extension base="c:Named"><xs:sequence>
<xs:element name="pet" type="c:Named" minOccurs="0" maxOccurs="unbounded"/><xs:choice><xs:element name="mail" type="xs:string"/><xs:element name="phone" type="xs:string"/></xs:choice>
</xs:sequence></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""
COMMON = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:c"><xs:complexType name="Named"><xs:sequence><xs:element name="name" type="Word"/></xs:sequence></xs:complexType>
<xs:complexType name="Word"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="language" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType></xs:schema>"""


def test_xsd(spark, tmp_path):
    files = {"main.xsd": MAIN, "common.xsd": COMMON}
    schema = xsd.load("main.xsd", files.__getitem__)
    doc = '<person><name language="en">Ann</name><pet><name>Rex</name></pet><mail>a@b</mail><unknown><x/></unknown></person>'
    df = spark.createDataFrame([(doc,), ("<person><name>", )], "doc string")
    got = [r.j for r in df.select(xsd.xml_to_json(F.col("doc"), schema, "person").alias("j")).collect()]
    assert got[0] == '{"name":{"language":"en","value":"Ann"},"pet":[{"name":{"value":"Rex"}}],"mail":"a@b"}'
    with pytest.raises(ValueError, match="Named"):
        xsd.load("main.xsd", lambda p: MAIN if p == "main.xsd" else '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"/>')


ORDER = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:sequence><xs:element name="person" type="xs:string"/>
<xs:element name="quantity" type="xs:positiveInteger"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def test_xml_validation(spark):
    schema, _ = xsd.parse(ORDER)
    docs = ["<order><person>a</person><quantity>3</quantity></order>", "<order><person>a</person><quantity>-3</quantity></order>", "<order><quantity>1</quantity></order>"]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    valid = lambda text: [r.ok for r in df.select(xsd.is_valid(F.col("doc"), schema, "order", xsd.share(spark, text)).alias("ok")).collect()]
    assert valid(ORDER) == [True, False, False]
    assert valid(ORDER.replace("positiveInteger", "integer")) == [True, True, False]
    assert valid(ORDER) == [True, False, False]


def test_schema_files_of_one_name(spark, tmp_path):
    """A user's own file called order.xsd and shared schemas don't get in each other's way."""
    for n, text in enumerate((ORDER, ORDER.replace("quantity", "number"))):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "order.xsd").write_text(text)
    spark.sparkContext.addFile(f"{tmp_path}/0/order.xsd")
    names = [xsd.share(spark, (tmp_path / str(n) / "order.xsd").read_text()) for n in (0, 1)]
    assert len(set(names)) == 2 and "order.xsd" not in names
    docs = spark.createDataFrame([("<order><person>a</person><number>3</number></order>",)], "doc string")
    schema, _ = xsd.parse(ORDER)
    assert [docs.select(xsd.is_valid(F.col("doc"), schema, "order", n).alias("ok")).first().ok for n in names] == [False, True]
