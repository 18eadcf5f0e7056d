"""XML Schema documents as Spark types, XML documents as JSON in their shape, and checks of their simple types.

Schema documents are small and read on the driver; the documents they describe
are parsed by Spark's own XML functions.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from .simple_types import SimpleType, valid

SPACE = "http://www.w3.org/2001/XMLSchema"
XS = f"{{{SPACE}}}"
#: How often a recursive type is followed on one path.
RECURSION = 4
#: A qualified name: its namespace ("" for none) and local part.
Name = tuple[str, str]
#: Fields for pieces of text, unknown tags and malformed documents, as long as Spark parses.
TEXT, WILD, BAD = "_text_", "_wild_", "_bad_"


@dataclass
class Element:
    name: str
    type: Name | ComplexType | SimpleType | None
    many: bool = False
    optional: bool = False
    #: The global element, or the group of elements, that stands here.
    ref: Name | None = None
    group: Name | None = None


@dataclass
class ComplexType:
    elements: list[Element] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    base: Name | None = None
    text: bool = False
    attribute_groups: list[Name] = field(default_factory=list)
    attribute_types: dict[str, Name | SimpleType] = field(default_factory=dict)
    #: Whether it may hold tags that the schema doesn't name.
    wild: bool = False


@dataclass
class Schema:
    """Root elements, types and groups by (namespace, name)."""

    elements: dict[Name, Element] = field(default_factory=dict)
    types: dict[Name, ComplexType] = field(default_factory=dict)
    simple: dict[Name, SimpleType] = field(default_factory=dict)
    groups: dict[Name, ComplexType] = field(default_factory=dict)

    def merge(self, other: Schema) -> Schema:
        """Both schemas; one name with two different definitions is an error."""
        for kind in ("elements", "types", "groups", "simple"):
            mine, theirs = getattr(self, kind), getattr(other, kind)
            for name in mine.keys() & theirs.keys():
                if mine[name] != theirs[name]:
                    raise ValueError(f"{name[1]} of namespace {name[0] or '(none)'} is defined twice")
        return Schema(self.elements | other.elements, self.types | other.types, self.simple | other.simple, self.groups | other.groups)

    def complex(self, kind: Name | ComplexType | SimpleType | None) -> ComplexType | None:
        return kind if isinstance(kind, ComplexType) else self.types.get(kind) if isinstance(kind, tuple) else None

    def children(self, kind: ComplexType) -> list[Element]:
        """The child elements of a type by name: its base's first, groups and references resolved. One that is named several times occurs many times."""
        found: dict[str, Element] = {}
        for e in self._particles(kind):
            found[e.name] = replace(found[e.name], many=True) if e.name in found else e
        return list(found.values())

    def child(self, kind: Name | ComplexType, name: str) -> Element | None:
        """A child element of a type by its name."""
        own = self.complex(kind)
        return next((e for e in self.children(own) if e.name == name), None) if own else None

    def is_many(self, kind: Name | ComplexType, name: str) -> bool:
        """Whether a child element may occur more than once."""
        found = self.child(kind, name)
        return found is not None and found.many

    def has_base(self, kind: Name, base: Name) -> bool:
        """Whether a type is another one or derives from it."""
        while kind is not None and kind != base:
            own = self.types.get(kind) or self.simple.get(kind)
            kind = own.base if own is not None and isinstance(own.base, tuple) else None
        return kind is not None

    def is_wild(self, kind: ComplexType) -> bool:
        """Whether a type may hold tags that the schema doesn't name."""
        base = self.complex(kind.base)
        return kind.wild or any(self.is_wild(self.groups[e.group]) for e in kind.elements if e.group is not None) or (base is not None and self.is_wild(base))

    def text_type(self, kind: ComplexType) -> Name | SimpleType | None:
        """The simple type of a complex type's text; None for mixed text."""
        while (base := self.complex(kind.base)) is not None:
            kind = base
        return kind.base if kind.text else None

    def attribute_type(self, kind: ComplexType, name: str) -> Name | SimpleType | None:
        base = self.complex(kind.base)
        own = [self.attribute_type(self.groups[g], name) for g in kind.attribute_groups]
        return kind.attribute_types.get(name) or next((t for t in own if t), None) or (self.attribute_type(base, name) if base else None)

    def has_text(self, kind: ComplexType) -> bool:
        base = self.complex(kind.base)
        return kind.text or (base is not None and self.has_text(base))

    def text_name(self, kind: ComplexType) -> str:
        """The name of a type's text: ``value``, with underscores before it until no child or attribute has it."""
        taken, name = {e.name for e in self.children(kind)} | set(self.attributes(kind)), "value"
        while name in taken:
            name = f"_{name}"
        return name

    def _particles(self, kind: ComplexType) -> list[Element]:
        base, found = self.complex(kind.base), []
        for e in kind.elements:
            if e.group is not None:
                found += [replace(x, many=x.many or e.many, optional=x.optional or e.optional) for x in self._particles(self.groups[e.group])]
            elif e.ref is not None:
                found.append(replace(self.elements[e.ref], many=e.many, optional=e.optional))
            else:
                found.append(e)
        return [*(self._particles(base) if base else []), *found]

    def attributes(self, kind: ComplexType) -> list[str]:
        base = self.complex(kind.base)
        own = [a for g in kind.attribute_groups for a in self.attributes(self.groups[g])] + kind.attributes
        return list(dict.fromkeys([*(self.attributes(base) if base else []), *own]))

    def unresolved(self) -> list[str]:
        """Names that are used and that nothing defines."""
        holders = [*self.types.values(), *self.groups.values(), ComplexType(list(self.elements.values()))]
        missing: set[Name] = set()
        while holders:
            t = holders.pop()
            for e in t.elements:
                missing |= {n for n, known in ((e.ref, self.elements), (e.group, self.groups)) if n and n not in known}
                if isinstance(e.type, ComplexType):
                    holders.append(e.type)
                else:
                    missing |= self._unknown(e.type)
            missing |= {g for g in t.attribute_groups if g not in self.groups}
            missing |= self._unknown(t.base).union(*map(self._unknown, t.attribute_types.values()))
        missing = missing.union(*map(self._unknown, self.simple.values()))
        return sorted(local for _, local in missing)

    def _unknown(self, kind: Name | SimpleType | None) -> set[Name]:
        """Names without a definition that a type, or a simple type's parts, are of."""
        if isinstance(kind, SimpleType):
            return set().union(*map(self._unknown, [kind.base, kind.item, *kind.members]))
        return {kind} if kind and kind[0] != SPACE and kind not in self.types and kind not in self.simple else set()

    def element(self, name: str, space: str | None = None) -> Element:
        """A root element by its local name, and namespace where several have it."""
        found = [e for (s, n), e in self.elements.items() if n == name and space in (None, s)]
        if len(found) != 1:
            raise KeyError(f"no root element {name}" if not found else f"{name} is in several namespaces: name one")
        return found[0]

    def struct(self, root: str, space: str | None = None, recursion: int = RECURSION, wildcards: bool = False) -> DataType:
        """The Spark type of a root element's documents; a type within itself is followed ``recursion`` times on a path, then it is text."""
        return self._type(self.element(root, space).type, (), recursion, wildcards, False)

    def _type(self, kind: Name | ComplexType | SimpleType | None, path: tuple, recursion: int, wildcards: bool, parsed: bool) -> DataType:
        """Complex types are structs: children, attributes, ``value`` for their text; in the type that Spark parses by, text is its pieces."""
        own = self.complex(kind)
        if own is None or path.count(id(own)) > recursion:
            return StringType()
        fields = []
        for e in self.children(own):
            inner = self._type(e.type, (*path, id(own)), recursion, wildcards, parsed)
            fields.append(StructField(e.name, ArrayType(inner) if e.many else inner))
        fields += [StructField(a, StringType()) for a in self.attributes(own)]
        if self.has_text(own):
            fields.append(StructField(TEXT, ArrayType(StringType())) if parsed else StructField(self.text_name(own), StringType()))
        if wildcards and self.is_wild(own):
            fields.append(StructField(WILD if parsed else "any", ArrayType(StringType())))
        return StructType(fields)

    def _shaped(self, raw: Column, kind: Name | ComplexType | SimpleType | None, path: tuple, recursion: int, wildcards: bool) -> Column:
        """What Spark parsed, with the pieces of each text put together."""
        own = self.complex(kind)
        if own is None or path.count(id(own)) > recursion:
            return raw
        fields = []
        for e in self.children(own):
            inner = lambda x, e=e: self._shaped(x, e.type, (*path, id(own)), recursion, wildcards)
            fields.append((F.transform(raw[e.name], lambda x: inner(x)) if e.many else inner(raw[e.name])).alias(e.name))  # noqa: B023
        fields += [raw[a].alias(a) for a in self.attributes(own)]
        if self.has_text(own):
            fields.append(F.array_join(raw[TEXT], "").alias(self.text_name(own)))
        if wildcards and self.is_wild(own):
            fields.append(raw[WILD].alias("any"))
        return F.when(raw.isNotNull(), F.struct(*fields))

    def cuts(self, kind: Name | ComplexType | SimpleType | None, recursion: int, path: tuple = (), names: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
        """Names from the root down to where a recursive type isn't followed any more."""
        own = self.complex(kind)
        if own is None:
            return []
        if path.count(id(own)) > recursion:
            return [names]
        return [c for e in self.children(own) for c in self.cuts(e.type, recursion, (*path, id(own)), (*names, e.name))]

    def simple_errors(self, value: Column, root: str, space: str | None = None, recursion: int = RECURSION) -> Column:
        """What is wrong with the simple values of a document (see xml_value): an array of texts, empty if nothing is. Absent ones aren't looked at."""
        return self._errors(value, self.element(root, space).type, (), recursion, root)

    def _errors(self, value: Column, kind: Name | ComplexType | SimpleType | None, path: tuple, recursion: int, place: str) -> Column:
        none = F.array().cast("array<string>")
        own = self.complex(kind)
        if own is None:
            if kind is None:
                return none
            label = kind[1] if isinstance(kind, tuple) else "its type"
            wrong = F.concat(F.lit(f"{place}: '"), value, F.lit(f"' isn't of {label}"))
            return F.when(value.isNotNull() & ~valid(value, kind, self.simple), F.array(wrong)).otherwise(none)
        if path.count(id(own)) > recursion:
            return none
        found = [none]
        for e in self.children(own):
            inner = lambda x, e=e: self._errors(x, e.type, (*path, id(own)), recursion, f"{place}/{e.name}")
            many = F.flatten(F.transform(F.coalesce(value[e.name], F.array()), lambda x: inner(x))) if e.many else None  # noqa: B023
            found.append(F.when(value[e.name].isNotNull(), many if e.many else inner(value[e.name])).otherwise(none))
        found += [self._errors(value[a], self.attribute_type(own, a), (), 0, f"{place}/@{a}") for a in self.attributes(own)]
        if self.has_text(own):
            found.append(self._errors(value[self.text_name(own)], self.text_type(own), (), 0, place))
        return F.concat(*found)


def parse(document: str, into: str = "") -> tuple[Schema, list[str]]:
    """One schema document and the places it imports or includes.

    Prefixes stand for what is declared on the tag that uses them or around it. An
    unprefixed name is of the default namespace, or where there is none, of the
    document's own: its target namespace or, in an included document without one,
    that of the document which includes it (``into``).
    """
    scopes: dict[ET.Element, dict[str, str]] = {}
    open_: list[dict[str, str]] = [{}]
    declared: dict[str, str] = {}
    events = ET.iterparse(io.BytesIO(document.encode()), ("start-ns", "start", "end"))
    for kind, what in events:
        if kind == "start-ns":
            declared[what[0]] = what[1]
        elif kind == "start":
            open_.append(open_[-1] | declared if declared else open_[-1])
            scopes[what], declared = open_[-1], {}
        else:
            open_.pop()
    top = events.root
    space = top.get("targetNamespace", into)
    schema = Schema()

    def qualified(name: str | None, node: ET.Element) -> Name | None:
        if not name:
            return None
        spaces, (prefix, _, local) = scopes[node], name.rpartition(":")
        if prefix and prefix not in spaces:
            raise ValueError(f"the prefix of {name} isn't declared")
        return (spaces[prefix] if prefix else spaces.get("", space), local)

    def many(node: ET.Element) -> bool:
        return node.get("maxOccurs", "1") not in ("0", "1")

    def inline(node: ET.Element) -> ComplexType | SimpleType | None:
        """The type that is defined where it is used."""
        inner, simple = node.find(XS + "complexType"), node.find(XS + "simpleType")
        return complex_type(inner) if inner is not None else simple_type(simple) if simple is not None else None

    def element(node: ET.Element) -> Element:
        kind = inline(node) or qualified(node.get("type"), node)
        ref = qualified(node.get("ref"), node)
        return Element(node.get("name") or (ref or ("", ""))[1], kind, many(node), node.get("minOccurs") == "0", ref)

    def simple_type(node: ET.Element) -> SimpleType:
        """A restriction with its facets, a list of items, or a union of members."""
        for child in node:
            if child.tag == XS + "restriction":
                own = child.find(XS + "simpleType")
                return SimpleType(base=simple_type(own) if own is not None else qualified(child.get("base"), child), facets=facets(child))
            if child.tag == XS + "list":
                own = child.find(XS + "simpleType")
                return SimpleType(item=simple_type(own) if own is not None else qualified(child.get("itemType"), child))
            if child.tag == XS + "union":
                named = [qualified(n, child) for n in child.get("memberTypes", "").split()]
                return SimpleType(members=(*named, *(simple_type(n) for n in child if n.tag == XS + "simpleType")))
        return SimpleType(base=(SPACE, "string"))

    def facets(node: ET.Element) -> tuple[tuple[str, str], ...]:
        return tuple((n.tag.removeprefix(XS), n.get("value")) for n in node if n.get("value") is not None and n.tag.startswith(XS))

    def content(node: ET.Element, into: ComplexType) -> None:
        for child in node:
            if child.tag in (XS + "sequence", XS + "choice", XS + "all", XS + "complexContent", XS + "simpleContent"):
                at = len(into.elements)
                content(child, into)
                for e in into.elements[at:] if many(child) else []:
                    e.many = True
                into.text |= child.tag == XS + "simpleContent"
            elif child.tag in (XS + "extension", XS + "restriction"):
                # a restriction of a complex type says again what it keeps
                into.base = qualified(child.get("base"), child) if child.tag == XS + "extension" or node.tag == XS + "simpleContent" else None
                if own := facets(child):
                    into.base = SimpleType(base=into.base, facets=own)
                content(child, into)
            elif child.tag == XS + "element":
                into.elements.append(element(child))
            elif child.tag == XS + "group" and child.get("ref"):
                into.elements.append(Element("", None, many(child), child.get("minOccurs") == "0", None, qualified(child.get("ref"), child)))
            elif child.tag == XS + "attribute" and child.get("use") != "prohibited" and (child.get("name") or child.get("ref")):
                name = child.get("name") or child.get("ref").split(":")[-1]
                into.attributes.append(name)
                if kind := inline(child) or qualified(child.get("type"), child):
                    into.attribute_types[name] = kind
            elif child.tag == XS + "any":
                into.wild = True
            elif child.tag == XS + "attributeGroup" and child.get("ref"):
                into.attribute_groups.append(qualified(child.get("ref"), child))

    def complex_type(node: ET.Element) -> ComplexType:
        made = ComplexType(text=node.get("mixed") == "true")
        content(node, made)
        return made

    for node in top:
        name = (space, node.get("name", ""))
        if node.tag == XS + "element":
            schema.elements[name] = element(node)
        elif node.tag == XS + "complexType":
            schema.types[name] = complex_type(node)
        elif node.tag in (XS + "group", XS + "attributeGroup"):
            schema.groups[name] = complex_type(node)
        elif node.tag == XS + "simpleType":
            schema.simple[name] = simple_type(node)
    return schema, [n.get("schemaLocation") for n in top if n.tag in (XS + "import", XS + "include") and n.get("schemaLocation")]


def _included(document: str) -> tuple[str, set[str]]:
    """A schema document's target namespace, and the places it includes."""
    top = ET.fromstring(document)
    return top.get("targetNamespace", ""), {n.get("schemaLocation") for n in top if n.tag == XS + "include"}


def load(main: str, fetch: Callable[[str], str], base: Schema | None = None) -> Schema:
    """A schema with all it imports and includes, each document once (one without a namespace once for each that includes it); names that nothing defines are an error."""
    whole, todo, seen = base or Schema(), [(main, "")], set()
    while todo:
        place, into = todo.pop(0)
        text = fetch(place) if (place, "") not in seen and (place, into) not in seen else None
        if text is None:
            continue
        space, includes = _included(text)
        into = "" if space else into
        if (place, into) in seen:
            continue
        seen.add((place, into))
        part, more = parse(text, into)
        whole = whole.merge(part)
        todo += [(m, space or into if m in includes else "") for m in more]
    if missing := whole.unresolved():
        raise ValueError(f"undefined types: {', '.join(missing)}")
    return whole


def _parsed(document: Column, schema: Schema, kind: Name | ComplexType | SimpleType | None, root: str, recursion: int, wildcards: bool, valid_by: str | None) -> Column:
    """What Spark makes of a document; BAD isn't null if it is malformed, or invalid by an XSD."""
    fields = StructType([*schema._type(kind, (), recursion, wildcards, True).fields, StructField(BAD, StringType())])
    options = {"attributePrefix": "", "valueTag": TEXT, "wildcardColName": WILD, "mode": "PERMISSIVE", "rowTag": root, "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": BAD}
    return F.from_xml(document, fields, options | ({"rowValidationXSDPath": valid_by} if valid_by else {}))


def xml_value(document: Column, schema: Schema, root: str, valid_by: str | None = None, space: str | None = None, recursion: int = RECURSION, wildcards: bool = False) -> Column:
    """A document as a struct of its schema; null if it is malformed, or invalid by the XSD at the path valid_by.

    Spark's parser goes by local names. A document that goes deeper into a recursive
    type than ``recursion`` is an error. With ``wildcards`` the content of tags that a
    schema allows without naming them is kept as texts of a field ``any``.
    """
    kind = schema.element(root, space).type
    parsed = _parsed(document, schema, kind, root, recursion, wildcards, valid_by)
    value = F.when(parsed[BAD].isNull(), schema._shaped(parsed, kind, (), recursion, wildcards))
    for names in schema.cuts(kind, recursion):
        below = "/*" + "".join(f"/*[local-name()='{n}']" for n in names)
        value = F.when(F.xpath_boolean(document, F.lit(below)), F.raise_error(F.lit(f"a document goes deeper than {recursion} times into {names[-1]}")).cast(schema.struct(root, space, recursion, wildcards))).otherwise(value)
    return value


def xml_to_json(document: Column, schema: Schema, root: str, space: str | None = None, recursion: int = RECURSION) -> Column:
    """A document as JSON: the root tag goes, repeatable elements are arrays, attributes are fields, text beside fields is ``value`` (see text_name), unknown tags are dropped."""
    return F.to_json(xml_value(document, schema, root, space=space, recursion=recursion))


def share(spark: SparkSession, document: str) -> str:
    """Send a schema document to all executors; the name that they know it by.

    The name is made of the content, so two schemas never meet under one name,
    whatever their files are called, and the same one may be shared again.
    """
    name = f"{hashlib.sha256(document.encode()).hexdigest()}.xsd"
    if name not in spark.sparkContext.listFiles:  # places of files that were shared before end in their names
        place = Path(tempfile.mkdtemp(prefix="xsd-")) / name
        place.write_text(document, encoding="utf-8")
        spark.sparkContext.addFile(str(place))
    return name


def is_valid(document: Column, schema: Schema, root: str, xsd_path: str, space: str | None = None, recursion: int = RECURSION) -> Column:
    """Whether a document is valid by an XSD that the executors have under this name (see share)."""
    parsed = _parsed(document, schema, schema.element(root, space).type, root, recursion, False, xsd_path)
    return document.isNotNull() & parsed[BAD].isNull()
