"""Declarative JSON reading and writing: a tree of protocols becomes one schema and one expression, either way.

Leaves are read as text and cast, so numbers in quotes are accepted. Reading has
three outcomes: a value, nothing (a required part is missing, or something of
another kind stands there: null without an error), or an error that tells what was
expected where. Writing gives nothing for null fields and the constants that
reading checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..tables import unused

NO_ERRORS = "array<string>"
#: Stands before strings that begin as an object or array does, while a document is parsed: two private characters.
MARK = "\ue0f7\ue0f8"
#: The last field of the object around a document: it isn't reached unless the document ends where it should.
END = "end of the document 5f1c9a"
#: Steps of a path besides fields' names: each element of an array, each field of an object.
EACH, ANY = object(), object()


def _none() -> Column:
    return F.array().cast(NO_ERRORS)


def _marked(name: str) -> str:
    return MARK + name if name[:1] in ("{", "[") else name


class Protocol:
    """How a part of a document is read: ``schema`` (all leaves text), ``value`` and ``errors`` of a column of it."""

    def schema(self) -> str:
        raise NotImplementedError

    def value(self, raw: Column) -> Column:
        raise NotImplementedError

    def errors(self, raw: Column, path: str) -> Column:
        return _none()

    def prepared(self, value: Column) -> Column:
        """What to_json writes of a value."""
        return value

    def map(self, f: Callable[[Column], Column], error: Callable[[Column], Column] | None = None, back: Callable[[Column], Column] | None = None) -> Protocol:
        """The value transformed; ``error`` may tell of a value why it can't be (null: it can), ``back`` makes it what it was for writing."""
        return Mapped(self, f, error, back)


@dataclass
class Scalar(Protocol):
    """Text cast to a type; anything but "true" is false; null, an object and an array are nothing."""

    kind: str

    def schema(self) -> str:
        return "string"

    @staticmethod
    def text(raw: Column) -> Column:
        """The text of a scalar; null for an object or array."""
        return F.when(F.substring(raw, 1, 1).isin("{", "["), None).otherwise(F.replace(raw, F.lit(MARK), F.lit("")))

    def value(self, raw: Column) -> Column:
        text = self.text(raw)
        if self.kind == "boolean":
            return text == "true"
        return text if self.kind == "string" else text.try_cast(self.kind)

    def errors(self, raw: Column, path: str) -> Column:
        if self.kind in ("string", "boolean"):
            return _none()
        text = self.text(raw)
        wrong = F.concat(F.lit(f"Expecting {self.kind} but was "), text, F.lit(f" at {path}"))
        return F.when(text.isNotNull() & text.try_cast(self.kind).isNull(), F.array(wrong)).otherwise(_none())


@dataclass
class Typed(Protocol):
    """A part that Spark reads by a type of its own (DDL): what doesn't fit that type is nothing."""

    ddl: str

    def schema(self) -> str:
        return self.ddl

    def value(self, raw: Column) -> Column:
        # strings keep the mark: the type may hold them anywhere
        return F.from_json(F.replace(F.to_json(F.struct(raw.alias("v"))), F.lit(MARK), F.lit("")), f"v {self.ddl}")["v"]


@dataclass
class Mapped(Protocol):
    inner: Protocol
    f: Callable[[Column], Column]
    error: Callable[[Column], Column] | None = None
    back: Callable[[Column], Column] | None = None

    def prepared(self, value: Column) -> Column:
        if self.back is None:
            raise TypeError("a mapped protocol writes only with the way back")
        return self.inner.prepared(self.back(value))

    def schema(self) -> str:
        return self.inner.schema()

    def value(self, raw: Column) -> Column:
        return self.f(self.inner.value(raw))

    def errors(self, raw: Column, path: str) -> Column:
        found = self.inner.errors(raw, path)
        if self.error is None:
            return found
        own = self.inner.value(raw)
        why = F.when(own.isNotNull(), self.error(own))
        return F.concat(found, F.when(why.isNotNull(), F.array(F.concat(why, F.lit(f" at {path}")))).otherwise(_none()))


@dataclass
class Many(Protocol):
    """Several values in a row. They have no brackets of their own: only Each may hold it."""

    inner: Protocol


def _single(*protocols: Protocol) -> None:
    for p in protocols:
        if isinstance(p, Many):
            raise TypeError("several values stand where one is read: put Each around them")


def _opened(raw: Column, inner: Protocol) -> Column:
    """An array's or a map's part as its protocol reads it; null if it is of another kind.

    Parts are held as text at first: one of another kind would spoil the whole.
    """
    kind = inner.schema()
    if kind == "string":
        return raw
    return F.when(F.substring(raw, 1, 1) == ("[" if kind.startswith("array") else "{"), F.from_json(raw, kind))


@dataclass
class Each(Protocol):
    """All elements of an array; an absent one is empty, elements that are nothing are left out."""

    inner: Protocol

    def __post_init__(self) -> None:
        if isinstance(self.inner, Many):
            self.inner = self.inner.inner
        _single(self.inner)

    def prepared(self, value: Column) -> Column:
        return F.transform(value, self.inner.prepared)

    def schema(self) -> str:
        return "array<string>"

    def value(self, raw: Column) -> Column:
        some = F.coalesce(raw, F.array().cast(self.schema()))
        return F.filter(F.transform(some, lambda x: self.inner.value(_opened(x, self.inner))), lambda x: x.isNotNull())

    def errors(self, raw: Column, path: str) -> Column:
        some = F.coalesce(raw, F.array().cast(self.schema()))
        return F.flatten(F.transform(some, lambda x: self.inner.errors(_opened(x, self.inner), f"{path}[]")))


@dataclass
class AnyField(Protocol):
    """Every field of an object as a map; of repeated fields the last counts, those that are nothing are left out."""

    inner: Protocol

    def __post_init__(self) -> None:
        _single(self.inner)

    def prepared(self, value: Column) -> Column:
        return F.transform_values(value, lambda _, v: self.inner.prepared(v))

    def schema(self) -> str:
        return "map<string,string>"

    def value(self, raw: Column) -> Column:
        names = F.reverse(F.map_keys(raw))
        last = F.filter(F.map_entries(raw), lambda e, i: F.size(names) - F.array_position(names, e["key"]) == i)
        read = F.transform(last, lambda e: F.struct(F.replace(e["key"], F.lit(MARK), F.lit("")).alias("key"), self.inner.value(_opened(e["value"], self.inner)).alias("value")))
        return F.map_from_entries(F.filter(read, lambda e: e["value"].isNotNull()))

    def errors(self, raw: Column, path: str) -> Column:
        some = F.coalesce(F.map_values(raw), F.array().cast("array<string>"))
        return F.flatten(F.transform(some, lambda v: self.inner.errors(_opened(v, self.inner), f"{path}.*")))


@dataclass
class Object(Protocol):
    """Fields by name; the object is nothing where a required one is, constants must be as given.

    An optional field that is nothing has its default, if there is one. Of
    repeated fields the last counts.
    """

    fields: dict[str, Protocol]
    optional: tuple[str, ...] = ()
    having: dict[str, object] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _single(*self.fields.values())
        if both := self.fields.keys() & self.having.keys():
            raise TypeError(f"{sorted(both)} can't be both fields and constants")

    def prepared(self, value: Column) -> Column:
        """Constants first; arrays and maps of optional fields aren't written when they are empty."""
        out = [F.lit(v).alias(n) for n, v in self.having.items()]
        for n, p in self.fields.items():
            own = value[n]
            if n in self.optional and isinstance(p, (Each, AnyField)):
                own = F.when(F.size(own) > 0, own)
            out.append(p.prepared(own).alias(n))
        return F.when(value.isNotNull(), F.struct(*out))

    def schema(self) -> str:
        parts = {n: p.schema() for n, p in self.fields.items()} | {n: "string" for n in self.having}
        return "struct<" + ",".join(f"`{_marked(n).replace('`', '``')}`:{k}" for n, k in parts.items()) + ">"

    def value(self, raw: Column) -> Column:
        values = {n: p.value(raw.getField(_marked(n))) for n, p in self.fields.items()}
        values = {n: F.coalesce(v, F.lit(self.defaults[n])) if n in self.defaults else v for n, v in values.items()}
        there = [v.isNotNull() for n, v in values.items() if n not in self.optional]
        there += [self._constant(raw, n).eqNullSafe(F.lit(_text(v))) for n, v in self.having.items()]
        whole = raw.isNotNull()
        for t in there:
            whole = whole & t
        return F.when(whole, F.struct(*(v.alias(n) for n, v in values.items())))

    def errors(self, raw: Column, path: str) -> Column:
        found = [p.errors(raw.getField(_marked(n)), f"{path}.{n}") for n, p in self.fields.items()]
        for n, v in self.having.items():
            own = self._constant(raw, n)
            wrong = F.concat(F.lit(f"must have {n} = {_text(v)} but was "), F.coalesce(own, F.lit("absent")), F.lit(f" at {path}"))
            found.append(F.when(raw.isNotNull() & ~own.eqNullSafe(F.lit(_text(v))), F.array(wrong)).otherwise(_none()))
        return F.concat(_none(), *found)

    @staticmethod
    def _constant(raw: Column, name: str) -> Column:
        return Scalar.text(raw.getField(_marked(name)))


def _text(constant: object) -> str:
    """A constant as a document has it."""
    return str(constant).lower() if isinstance(constant, bool) else str(constant)


def _parsed(text: Column, protocol: Protocol) -> Column:
    """(value, END) of a document: END isn't 0 where it isn't JSON, or more stands behind it."""
    marked = F.when(text.contains('"{') | text.contains('"['), F.regexp_replace(text, r'"([{\[])', f'"{MARK}$1')).otherwise(text)
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.from_json(F.concat(F.lit('{"value":'), marked, F.lit(f',"{END}":0}}')), f"value {protocol.schema()}, `{END}` int", options)


def _outcome(text: Column, parsed: Column, protocol: Protocol) -> tuple[Column, Column]:
    raw = parsed["value"]
    errors = protocol.errors(raw, "$")
    malformed = text.isNotNull() & parsed[END].isNull()
    error = F.when(malformed, F.lit("not JSON")).when(raw.isNotNull() & (F.size(errors) > 0), F.array_join(errors, "; "))
    return F.when(error.isNull() & raw.isNotNull(), protocol.value(raw)), error


def decoded(text: Column, protocol: Protocol) -> tuple[Column, Column]:
    """(value, error) of JSON text. An error hides the value; text that isn't one JSON document, and no more, is an error.

    A document of another kind than the protocol's (an array where an object is
    read, a number) is nothing. Decimal fractions beyond a double's digits are
    rounded to it by Spark's parser unless they are in quotes; integers keep theirs.
    """
    _single(protocol)
    return _outcome(text, _parsed(text, protocol), protocol)


def first_of(text: Column, protocol: Protocol) -> Column:
    """The first element of an array that isn't nothing, or the document itself where it is none; an error if there is none."""
    many, wrong = decoded(text, Each(protocol))
    one, other = decoded(text, protocol)
    is_array = F.substring(F.ltrim(text), 1, 1) == "["
    why = F.coalesce(F.when(is_array, wrong).otherwise(other), F.lit("no element"))
    found = F.when(is_array, F.get(many, F.lit(0))).otherwise(one)
    return F.when(found.isNotNull(), found).when(text.isNull(), None).when(F.raise_error(why).cast("boolean"), found)


def elements(df: DataFrame, column: str, path: str | list[object], protocol: Protocol, name: str = "element") -> DataFrame:
    """One row for each part of the documents at a path, in order; documents without it give none, an error is raised.

    Steps of a path are names of fields, EACH for all elements of an array and ANY for
    all fields of an object; a name alone stands for the elements of the array in
    that field. Parts that are nothing give no row.
    """
    steps = [path, EACH] if isinstance(path, str) else path
    tree = protocol
    for i in range(len(steps) - 1, -1, -1):
        tree = Each(tree) if steps[i] is EACH else AnyField(tree) if steps[i] is ANY else Object({steps[i]: tree}, optional=(steps[i],))
    parsed, part = unused(df, "_parsed", "_part")
    # the parsed document is a column of its own, so that it is parsed once
    found = df.withColumn(parsed, _parsed(F.col(column), tree))
    value, error = _outcome(F.col(column), F.col(parsed), tree)
    checked = F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True)
    found = found.where(checked).withColumn(part, value).drop(parsed)
    for step in steps:
        inner = F.explode(part) if step is EACH else F.explode(F.map_values(part)) if step is ANY else F.col(part)[step]
        found = found.select(*(c for c in found.columns if c != part), inner.alias(part))
    return found.where(F.col(part).isNotNull()).withColumn(name, F.col(part)).drop(part)


def for_each(parts: DataFrame, do: Callable[[Row], None]) -> None:
    """Call a function for its effect with each row (of elements, say), in the tasks, one after the other in a partition; at least once."""

    def run(rows) -> None:
        for row in rows:
            do(row)

    parts.foreachPartition(run)


def read(df: DataFrame, column: str, protocol: Protocol) -> DataFrame:
    """df with value and error of a JSON column; rows that are nothing (no value, no error) are left out."""
    _single(protocol)
    (parsed,) = unused(df, "_parsed")
    found = df.withColumn(parsed, _parsed(F.col(column), protocol))
    value, error = _outcome(F.col(column), F.col(parsed), protocol)
    return found.withColumns({"value": value, "error": error}).where("value is not null or error is not null").drop(parsed)


def encoded(value: Column, protocol: Protocol) -> Column:
    """JSON text of a value as its protocol reads it: compact, constants first; null stays null."""
    whole = F.to_json(F.array(protocol.prepared(value)))
    return F.when(value.isNotNull(), whole.substr(F.lit(2), F.length(whole) - 2))


def any_of(text: Column, *protocols: Protocol) -> tuple[Column, Column]:
    """The first alternative that succeeds; if none does, all their errors. Alternatives must give one type."""
    tried = [decoded(text, p) for p in protocols]
    value = F.coalesce(*(v for v, _ in tried))
    return value, F.when(value.isNull(), F.nullif(F.concat_ws(", alternatively ", *(e for _, e in tried)), F.lit("")))


def combined(text: Column, *protocols: Protocol) -> Column:
    """Every alternative that succeeds, as an array."""
    return F.filter(F.array(*(decoded(text, p)[0] for p in protocols)), lambda v: v.isNotNull())


def write(value: Column, having: dict[str, str] | None = None, may_be_empty: tuple[str, ...] = ()) -> Column:
    """Compact JSON of a struct, constants first; null fields, and arrays of may_be_empty without elements, aren't written."""
    for n in may_be_empty:
        value = value.withField(n, F.when(F.size(value[n]) > 0, value[n]))
    own = F.to_json(value)
    if not having:
        return own
    first = F.to_json(F.struct(*(F.lit(v).alias(n) for n, v in having.items())))
    return F.when(own == "{}", first).otherwise(F.concat(first.substr(F.lit(1), F.length(first) - 1), F.lit(","), own.substr(F.lit(2), F.length(own))))
