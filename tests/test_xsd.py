"""Schemas: repeats, mixed text, recursion, includes, prefixes, simple types, questions."""

import pytest
from pyspark.sql import functions as F

from eventlake.sources import xsd
from eventlake.sources.simple_types import SimpleType, valid

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" '
XS = xsd.SPACE


def jsons(spark, schema, root, *docs, **more):
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    return [r.j for r in df.select(xsd.xml_to_json(F.col("d"), schema, root, **more).alias("j")).collect()]


def test_nothing_is_lost(spark):
    schema, _ = xsd.parse(HEAD + """><xs:group name="g"><xs:sequence><xs:element name="a" type="xs:string"/></xs:sequence></xs:group><xs:element name="r"><xs:complexType mixed="true"><xs:sequence><xs:element name="a" type="xs:string"/><xs:element name="b"><xs:complexType mixed="true"><xs:sequence>
<xs:element name="value" type="xs:string" minOccurs="0"/><xs:element name="_value" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element><xs:group ref="g"/></xs:sequence><xs:attribute name="k"/></xs:complexType></xs:element></xs:schema>""")
    got = jsons(spark, schema, "r", "<r k='1'> x <a>1</a><!-- no --> y<b>p<value>q</value> s </b><a> 2 </a><![CDATA[<z>]]></r>", "<r><b><_value>u</_value></b></r>", "<r", None)
    assert got == ['{"a":["1"," 2 "],"b":{"value":"q","__value":"p s "},"k":"1","value":" x  y<z>"}', '{"b":{"_value":"u"}}', None, None]


def test_recursion_is_an_error_or_a_parameter(spark):
    schema, _ = xsd.parse(HEAD + '><xs:element name="n" type="N"/><xs:complexType name="N"><xs:sequence><xs:element name="n" type="N" minOccurs="0"/><xs:element name="v" type="xs:int" minOccurs="0"/></xs:sequence></xs:complexType></xs:schema>')
    doc = "<n>" * 7 + "<v>5</v>" + "</n>" * 7
    assert jsons(spark, schema, "n", doc, recursion=6) == ['{"n":' * 6 + '{"v":"5"}' + "}" * 6]
    with pytest.raises(Exception, match="deeper than 4 times into n"):
        jsons(spark, schema, "n", doc)
    assert jsons(spark, schema, "n", "<n>" * 5 + "<v>5</v>" + "</n>" * 5) == ['{"n":' * 4 + '{"v":"5"}' + "}" * 4]


def test_includes_and_prefixes(spark):
    part = HEAD + '><xs:complexType name="T"><xs:sequence><xs:element name="u" type="U"/></xs:sequence></xs:complexType><xs:simpleType name="U"><xs:restriction base="xs:string"/></xs:simpleType></xs:schema>'
    main = lambda n: HEAD + f'xmlns:m="urn:{n}" targetNamespace="urn:{n}"><xs:include schemaLocation="part"/><xs:import schemaLocation="{"b" if n == "a" else "a"}"/><xs:element name="{n}" type="m:T"/></xs:schema>'
    fetched = []
    schema = xsd.load("a", lambda p: (fetched.append(p), {"part": part, "a": main("a"), "b": main("b")}[p])[1])
    assert {("urn:a", "T"), ("urn:b", "T")} == set(schema.types) and fetched.count("a") == fetched.count("b") == 1
    assert schema.struct("b").simpleString() == "struct<u:string>"
    deep, _ = xsd.parse(HEAD + 'targetNamespace="urn:x" xmlns:p="urn:x"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="p:T"/><xs:element xmlns:p="urn:y" name="b" type="p:T"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    assert [e.type for e in deep.children(deep.elements["urn:x", "r"].type)] == [("urn:x", "T"), ("urn:y", "T")]
    with pytest.raises(ValueError, match="prefix"):
        xsd.parse(HEAD + '><xs:element name="r" type="q:T"/></xs:schema>')
    with pytest.raises(ValueError, match="Gone"):
        xsd.load("x", lambda _: HEAD + '><xs:simpleType name="L"><xs:list itemType="Gone"/></xs:simpleType></xs:schema>')


FACETS = HEAD + """><xs:simpleType name="Grade"><xs:restriction base="xs:integer"><xs:minInclusive value="1"/><xs:maxExclusive value="7"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Good"><xs:restriction base="Grade"><xs:enumeration value="1"/><xs:enumeration value="02"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Code"><xs:restriction base="xs:token"><xs:pattern value="[A-Z]{2}"/><xs:pattern value="x+"/><xs:maxLength value="3"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Grades"><xs:restriction><xs:simpleType><xs:list itemType="Grade"/></xs:simpleType><xs:minLength value="2"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Either"><xs:union memberTypes="Grade xs:date"><xs:simpleType><xs:restriction base="xs:string"><xs:length value="0"/></xs:restriction></xs:simpleType></xs:union></xs:simpleType>
<xs:simpleType name="Price"><xs:restriction base="xs:decimal"><xs:totalDigits value="4"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Late"><xs:restriction base="xs:date"><xs:minInclusive value="2024-02-01"/></xs:restriction></xs:simpleType>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="g" type="Grade" maxOccurs="9"/><xs:element name="p" type="P" minOccurs="0"/><xs:any minOccurs="0"/></xs:sequence><xs:attribute name="c" type="Code"/>
<xs:attribute name="i"><xs:simpleType><xs:restriction base="xs:int"/></xs:simpleType></xs:attribute></xs:complexType></xs:element>
<xs:complexType name="P"><xs:simpleContent><xs:extension base="Price"><xs:attribute name="cur" type="Code"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="Q"><xs:complexContent><xs:extension base="P"/></xs:complexContent></xs:complexType></xs:schema>"""


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("Grade", ["1", " 6\n", "+3"], ["0", "7", "1.5", "", "-99999999999999999999999999999999999999999", "9" * 50]), ("Good", ["1", "2", "02"], ["3", "7"]), ("Code", ["AB", "xxx", " AB "], ["ABC", "xxxx", "A B", "a"]),
        ("Grades", ["1 2", " 6  6 6 "], ["1", "", "1 9"]), ("Either", ["3", "2024-01-01", ""], ["9", "x", " x"]), ("Price", ["12.34", "0012.3400", "-1234", "0.00"], ["12.345", "12345", "123.45"]),
        ("Late", ["2024-02-01", "2025-01-01Z"], ["2024-01-31", "2024-02-30"]),
    ],
)
def test_derived_types(spark, name, good, bad):
    schema, _ = xsd.parse(FACETS)
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    assert [r.v for r in df.select(valid(F.col("t"), ("", name), schema.simple).alias("v")).collect()] == [True] * len(good) + [False] * len(bad) + [None]


def test_values_of_documents(spark):
    schema, _ = xsd.parse(FACETS)
    docs = ["<r c='AB' i='5'><g>1</g><g>2</g><p cur='x'>1.5</p></r>", "<r c='abc' i='x'><g>1</g><g>9</g><p cur='?'>1.555</p><q>w</q></r>", "<r><g>1</g></r>"]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(xsd.xml_value(F.col("d"), schema, "r", wildcards=True).alias("v"))
    got = df.select("v", schema.simple_errors(F.col("v"), "r").alias("e")).collect()
    assert [sorted(r.e) for r in got] == [[], ["r/@c: 'abc' isn't of Code", "r/@i: 'x' isn't of its type", "r/g: '9' isn't of Grade", "r/p/@cur: '?' isn't of Code", "r/p: '1.555' isn't of Price"], []]
    assert got[1].v.any == ["w"] and got[0].v.any is None


def test_questions(spark):
    schema, _ = xsd.parse(FACETS)
    r = schema.elements["", "r"].type
    assert [e.name for e in schema.children(r)] == ["g", "p"] and schema.is_many(r, "g") and not schema.is_many(r, "p") and not schema.is_many(r, "x") and schema.child(r, "x") is None
    assert schema.is_wild(r) and schema.attributes(("", "P") and schema.types["", "Q"]) == ["cur"]
    assert schema.has_base(("", "Q"), ("", "P")) and schema.has_base(("", "Good"), (XS, "integer")) and not schema.has_base(("", "P"), ("", "Q"))
    assert schema.text_type(schema.types["", "Q"]) == ("", "Price")
    assert schema.simple["", "Either"].members[:2] == (("", "Grade"), (XS, "date")) and isinstance(schema.simple["", "Either"].members[2], SimpleType)
