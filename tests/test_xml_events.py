"""XML by qualified name: events, tags, selection, places of errors, writing."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from eventlake.sources import xml_events as xe
from eventlake.sources.xml_events import Part, qname

A, B = "urn:a", "urn:b"
DOC = f"""<a:list xmlns:a="{A}" xmlns:b="{B}"><a:item size="3" b:size="4">one</a:item><b:item>two<!-- no --> more</b:item><c><a:item><a:item>deep</a:item></a:item><empty/></c></a:list>"""


@pytest.fixture
def docs(spark):
    rows = [(1, DOC), (2, "<a:list xmlns:a='urn:other'><a:item>x</a:item></a:list>"), (3, None), (4, "<r>\n <s>1</s>\n <s>é2</r>"), (5, "")]
    return spark.createDataFrame(rows, "id int, doc string").withColumn("event", F.lit("taken")).repartition(2)


def test_events(spark, docs):
    rows = docs.where("id = 1").select("id", "doc")
    found = [r.event for r in xe.events(rows, "doc").orderBy("event.nr").collect()]
    assert [e.nr for e in found] == list(range(1, len(found) + 1))
    assert [(e.kind, e.name or e.text) for e in found][:6] == [("start", qname("list", A)), ("start", qname("item", A)), ("text", "one"), ("end", qname("item", A)), ("start", qname("item", B)), ("text", "two more")]
    assert [(n.prefix, n.space) for n in found[0].namespaces] == [("a", A), ("b", B)]
    assert [(a.name, a.prefix, a.value) for a in found[1].attributes] == [("size", "", "3"), (qname("size", B), "b", "4")]
    assert found[2].path == [qname("list", A), qname("item", A)] and found[2].opened == [1, 2]
    assert found[0].col == DOC.index(">") + 2 and found[2].col == DOC.index("one") + 4
    assert xe.events(docs, "doc").where("event.kind = 'error'").select("id").orderBy("id").collect() == [(4,), (5,)]


def test_long_and_odd_texts(spark, monkeypatch):
    inner = "".join(f"<t n='{i}'>{'ä&amp;' * (i % 7)}<![CDATA[<{i}>]]></t>\n" for i in range(9000))
    doc = f"<?xml version='1.0' encoding='latin-1'?><!DOCTYPE r><r>{'z' * 300_000}{inner}</r>"
    df = spark.createDataFrame([(doc,)], "doc string")
    tags = xe.tags(df, "doc").select("tag.*").orderBy("nr").collect()
    root = ET.fromstring(doc.replace(" encoding='latin-1'", "").encode())
    assert [(t.name, t.text) for t in tags[1:]] == [(t.tag, t.text or None) for t in root]
    assert tags[0].text == "z" * 300_000 + "".join(t.tail for t in root)
    lines = [t.line for t in tags[1:]]
    assert lines == list(range(1, 9001))
    pieces = xe.events(df, "doc").where("event.kind = 'text' and size(event.path) = 1").select("event.*").orderBy("nr").limit(3).collect()
    assert max(len(p.text) for p in pieces) < 2 * xe.TEXT


def test_selection(spark, docs):
    tag = F.col("tag")
    tags = xe.tags(docs.select("id", "doc"), "doc")
    item = [(r.id, r.name, r.text) for r in tags.where(tag["name"] == qname("item", A)).select("id", "tag.*").orderBy("nr").collect()]
    assert item == [(1, qname("item", A), "one"), (1, qname("item", A), None), (1, qname("item", A), "deep")]
    assert {r.text for r in tags.where(xe.at_path(tag, qname("list", A), None)).select("tag.text").collect()} == {"one", "two more", None}
    event = F.col("event")
    events = xe.events(docs.select("id", "doc"), "doc")
    picked = events.withColumn("of", xe.sub_tag(event, qname("item", A), qname("item", B))).where("of is not null")
    assert [tuple(r) for r in xe.documents(picked, ["id", "of"]).orderBy("id", "of").collect()] == [
        (1, 2, f'<a:item xmlns:a="{A}" xmlns:b="{B}" size="3" b:size="4">one</a:item>'),
        (1, 5, f'<b:item xmlns:b="{B}">two more</b:item>'),
        (1, 9, f'<a:item xmlns:a="{A}"><a:item>deep</a:item></a:item>'),
    ]
    assert events.where(xe.within(event, qname("list", A), "c")).count() == 9
    assert events.where(xe.sub_tag(event, "item").isNotNull()).count() == 0


def test_maps(spark, docs):
    tags = xe.tags(docs.select("id", "doc"), "doc")
    bodies = xe.map_of(tags, ["id"], qname("list", A)).collect()
    assert [(r.id, r.tag, r["values"]) for r in bodies] == [(1, 1, {qname("item", A): "one", qname("item", B): "two more"})]
    assert [r["values"] for r in xe.map_of(tags, ["id"], qname("list", A), local=True).collect()] == [{"item": "two more"}]
    assert [r["values"] for r in xe.map_of(tags, ["id"], None, of="size").collect()] == [{qname("item", A): "3"}]


def test_records_and_places(spark):
    box = {"weight": Part("weight", "bigint"), "floor": Part("floor", "int", attribute=True, optional=True), "labels": Part("label", many=True)}
    texts = [
        "<box floor='2'><label>heavy</label><weight>900</weight><label>glass</label><label/></box>", "<box><weight>1</weight></box>", "<box><label>x</label></box>",
        "<box\n floor='up'><weight>7</weight></box>", "<box><weight>1</weight><weight>\n12x</weight></box>", "<tin><weight>1</weight></tin>", "<box floor='3' ><weight/></box>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    found = {r.id: r for r in xe.records(xe.tags(df, "doc"), ["id"], box, "box").collect()}
    assert set(found) == {0, 1, 3, 4}
    assert (found[0].weight, found[0].floor, found[0].labels, found[0].error) == (900, 2, ["heavy", "glass"], None)
    assert (found[1].weight, found[1].floor, found[1].labels) == (1, None, [])
    assert found[3].error == "Expecting int but was up at 2:13" and found[3].weight is None
    assert found[4].error == "Expecting bigint but was \n12x at 2:4"


def start(name, prefix="", attributes=(), namespaces=()):
    return {"kind": "start", "name": name, "prefix": prefix, "attributes": [dict(zip(("name", "prefix", "value"), a)) for a in attributes], "namespaces": [dict(zip(("prefix", "space"), n)) for n in namespaces]}


END = {"kind": "end"}


@pytest.mark.parametrize(
    ("rows", "text"),
    [
        ([start(qname("t", A), "p"), start(qname("t", B), "p", [(qname("x", "urn:c"), "q", "<1>")]), END, start(qname("t", A), "p"), END, END],
         '<p:t xmlns:p="urn:a"><p:t xmlns:p="urn:b" xmlns:q="urn:c" q:x="&lt;1&gt;"/><p:t/></p:t>'),
        ([start(qname("t", A)), start(qname("t", B)), END, start("plain"), END, END], '<t xmlns="urn:a"><t xmlns="urn:b"/><plain xmlns=""/></t>'),
        ([start(qname("t", A), "", (), [("b", B), ("", A)]), start(qname("u", B), "b", (), [("b", B), ("c", "urn:c")]), {"kind": "text", "text": "a<&\r"}, END, END],
         '<t xmlns="urn:a" xmlns:b="urn:b"><b:u xmlns:c="urn:c">a&lt;&amp;&#13;</b:u></t>'),
        ([start(qname("t", A), "p", [(qname("x", B), "p", "1"), (qname("y", B), "", "2"), (qname("lang", xe.XML), "xml", "en"), ("z", "", '"')]), END],
         """<p:t xmlns:p="urn:a" xmlns:ns0="urn:b" ns0:x="1" ns0:y="2" xml:lang="en" z='"'/>"""),
    ],
)
def test_declarations_are_mended(rows, text):
    got = xe.written_text(iter(rows))
    ET.fromstring(got)
    assert got == text


def test_malformed_events_are_not_written(spark, docs):
    with pytest.raises(Exception, match="mismatched tag at 3:9"):
        xe.documents(xe.events(docs.where("id = 4").select("id", "doc"), "doc"), ["id"]).collect()
