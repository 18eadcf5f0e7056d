"""XML by qualified name: documents as rows of events or of tags, selected, read and written with their namespaces.

A document is parsed incrementally in Arrow batches; every row knows the names of
the tags that it is within, so picking sub-trees by name at any depth, bodies into
maps, or records with typed fields is a filter or an aggregate like any other. Names
are ``{namespace}local``, or ``local`` without a namespace (see qname). A place is a
line and a column, both from 1, right behind what it belongs to; an attribute has its
tag's place, as parsers know no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

#: Bytes that are parsed before their rows go on, code points of a text event at most (about), and rows of a batch.
PIECE, TEXT, ROWS = 1 << 16, 1 << 16, 5000
XML = "http://www.w3.org/XML/1998/namespace"
EVENT = (
    "nr long, kind string, name string, prefix string, text string, attributes array<struct<name:string,prefix:string,value:string>>, "
    "namespaces array<struct<prefix:string,space:string>>, line int, col int, path array<string>, opened array<long>"
)
TAG = "nr long, name string, text string, attributes array<struct<name:string,prefix:string,value:string>>, line int, col int, text_line int, text_col int, path array<string>, opened array<long>, error string"


def qname(local: str, space: str = "") -> str:
    return f"{{{space}}}{local}" if space else local


def local_name(name: Column) -> Column:
    return F.regexp_extract(name, r"[^}]*$", 0)


class _Document:
    """The events of one document, fed piece by piece: dicts, each complete once another one has followed."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.path: list[str] = []
        self.opened: list[int] = []
        self.nr = 0
        self.spaces: list[dict] = []
        p = self.parser = expat.ParserCreate("utf-8", "\x1f")
        p.namespace_prefixes = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._characters
        p.StartNamespaceDeclHandler = self._declared
        p.StartCdataSectionHandler = p.EndCdataSectionHandler = self._place
        p.CommentHandler = p.ProcessingInstructionHandler = p.DefaultHandlerExpand = self._place
        p.ordered_attributes = True

    def _place(self, *_: object) -> None:
        """What came last ends where something new begins."""
        if self.rows and self.rows[-1]["line"] is None:
            self.rows[-1].update(line=self.parser.CurrentLineNumber, col=self.parser.CurrentColumnNumber + 1)

    def _add(self, kind: str, **more: object) -> None:
        self.nr += 1
        empty = {"name": None, "prefix": None, "text": None, "attributes": None, "namespaces": None, "line": None, "col": None}
        self.rows.append({"nr": self.nr, "kind": kind, **empty, "path": list(self.path), "opened": list(self.opened), **more})

    @staticmethod
    def _split(name: str) -> tuple[str, str]:
        """(qualified name, prefix) of the parser's space, local part and prefix."""
        space, local, prefix = ["", *name.split("\x1f"), ""][:3] if "\x1f" not in name else [*name.split("\x1f"), ""][:3]
        return qname(local, space), prefix

    def _declared(self, prefix: str | None, space: str | None) -> None:
        self._place()
        self.spaces.append({"prefix": prefix or "", "space": space or ""})

    def _start(self, name: str, attributes: list[str]) -> None:
        self._place()
        name, prefix = self._split(name)
        self.path.append(name)
        self.opened.append(self.nr + 1)
        found = [{"name": n, "prefix": p, "value": v} for (n, p), v in zip(map(self._split, attributes[::2]), attributes[1::2])]
        self._add("start", name=name, prefix=prefix, attributes=found, namespaces=self.spaces)
        self.spaces = []

    def _end(self, name: str) -> None:
        self._place()
        name, prefix = self._split(name)
        self._add("end", name=name, prefix=prefix)
        self.path.pop()
        self.opened.pop()

    def _characters(self, text: str) -> None:
        last = self.rows[-1] if self.rows else None
        if last and last["kind"] == "text" and len(last["text"]) < TEXT:
            last["text"] += text
            last["line"] = None
        else:
            self._place()
            self._add("text", text=text)

    def feed(self, data: bytes, final: bool) -> Iterator[dict]:
        """Rows that are complete; malformed input is a last row of kind ``error``."""
        try:
            self.parser.Parse(data, final)
        except expat.ExpatError as wrong:
            self._place()
            self._add("error", text=f"{expat.ErrorString(wrong.code)} at {wrong.lineno}:{wrong.offset + 1}", line=wrong.lineno, col=wrong.offset + 1)
            final = True
        if final:
            self._place()
        done, self.rows = (self.rows, []) if final else (self.rows[:-1], self.rows[-1:])
        yield from done


def _events(text: str) -> Iterator[dict]:
    document, data = _Document(), text.encode()
    for at in range(0, max(len(data), 1), PIECE):
        for row in document.feed(data[at : at + PIECE], at + PIECE >= len(data)):
            yield row
            if row["kind"] == "error":
                return


def _tags(text: str) -> Iterator[dict]:
    """One row for each tag when it ends: its attributes, and the text directly in it (none: null)."""
    open_: list[dict] = []
    for e in _events(text):
        if e["kind"] == "start":
            open_.append({k: e[k] for k in ("nr", "name", "attributes", "line", "col", "path", "opened")} | {"text": [], "text_line": None, "text_col": None, "error": None})
        elif e["kind"] == "text":
            open_[-1]["text"].append(e["text"])
            open_[-1].update(text_line=e["line"], text_col=e["col"])
        elif e["kind"] == "end":
            tag = open_.pop()
            yield tag | {"text": "".join(tag["text"]) or None}
        else:
            yield dict.fromkeys(("name", "text", "attributes", "text_line", "text_col")) | {k: e[k] for k in ("nr", "line", "col", "path", "opened")} | {"error": e["text"]}


def _rows(docs: DataFrame, column: str, name: str, kind: DataType, parse) -> DataFrame:
    keep = [c for c in docs.columns if c not in (column, name)]
    source = docs.select(*keep, F.col(column).cast("string").alias(name))
    schema = StructType([*source.select(*keep).schema.fields, StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        made = to_arrow_type(kind)
        for batch in batches:
            held, of = [], []

            def out() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(held, made)], [*keep, name])  # noqa: B023

            for i, text in enumerate(batch.column(name)):
                for row in parse(text.as_py()) if text.is_valid else ():
                    held.append(row)
                    of.append(i)
                    if len(held) >= ROWS:
                        yield out()
                        held, of = [], []
            if held:
                yield out()

    return source.mapInArrow(run, schema)


def _kind(fields: str) -> StructType:
    return StructType.fromDDL(fields)


def events(docs: DataFrame, column: str, name: str = "event") -> DataFrame:
    """docs with one row for each event of the documents in a column, in place of it: a struct (see EVENT) named ``name``.

    Kinds are start, text, end and, last in a document that is malformed, error. nr
    numbers a document's events from 1; path and opened are the names and numbers of
    the tags from the root to the event's own. Long text comes as several events;
    comments and instructions are left out. Null documents have no events.
    """
    return _rows(docs, column, name, _kind(EVENT), _events)


def tags(docs: DataFrame, column: str, name: str = "tag") -> DataFrame:
    """docs with one row for each tag of the documents in a column, in place of it: a struct (see TAG) named ``name``.

    text is all character data directly in the tag, null if there is none. A
    malformed document gives the tags that had ended and a row with the error.
    """
    return _rows(docs, column, name, _kind(TAG), _tags)


# Selection


def at_path(row: Column, *names: str | None) -> Column:
    """Whether a tag, or an event's tag, is the one at these names from the root on; None stands for any name."""
    ok = F.size(row["path"]) == len(names)
    for i, n in enumerate(names):
        ok = ok if n is None else ok & (F.get(row["path"], F.lit(i)) == n)
    return ok


def within(row: Column, *names: str | None) -> Column:
    """Whether an event belongs to a tag at these names from the root on, or to anything in it."""
    return F.when(F.size(row["path"]) >= len(names), at_path(F.struct(F.slice(row["path"], 1, len(names)).alias("path")), *names)).otherwise(F.lit(False))


def sub_tag(row: Column, *names: str) -> Column:
    """Number of the outermost tag of one of these names that a row belongs to, itself included; null if none. Names match with their namespace, at any depth."""
    place = F.array_position(F.transform(row["path"], lambda n: n.isin(*names)), F.lit(True))
    return F.when(place > 0, F.get(row["opened"], (place - 1).cast("int")))


def attribute(row: Column, name: str) -> Column:
    """The value of an attribute; null if the tag hasn't it."""
    return F.get(F.filter(row["attributes"], lambda a: a["name"] == name), F.lit(0))["value"]


def map_of(tags_: DataFrame, keys: list[str], *parent: str | None, of: str | None = None, local: bool = False, name: str = "tag") -> DataFrame:
    """(keys, tag, values): for each tag at ``parent`` (its number) the names of the tags directly in it and their bodies, or their attribute ``of``, as a map.

    Tags without a body (or the attribute) are left out, of repeated names the
    last counts; parents without any give no row. ``local`` drops namespaces.
    """
    row = F.col(name)
    value = row["text"] if of is None else attribute(row, of)
    own = F.get(row["opened"], F.lit(len(parent) - 1))
    label = local_name(row["name"]) if local else row["name"]
    each = tags_.where(at_path(row, *parent, None) & value.isNotNull()).select(*keys, own.alias("_tag"), label.alias("_label"), row["nr"].alias("_nr"), value.alias("_value"))
    last = each.groupBy(*keys, "_tag", "_label").agg(F.max_by("_value", "_nr").alias("_value"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("_label", "_value"))))
    return last.groupBy(*keys, "_tag").agg(whole.alias("values")).withColumnRenamed("_tag", name)


@dataclass(frozen=True)
class Part:
    """A field of a record: the body of a tag directly in it, or one of its attributes, cast to a type."""

    name: str
    kind: str = "string"
    attribute: bool = False
    optional: bool = False
    many: bool = False


def _typed(found: Column, kind: str) -> tuple[Column, Column]:
    """(value, error) of a struct (text, line, col)."""
    value = found["text"] if kind == "string" else F.trim(found["text"]).try_cast(kind)
    why = F.concat(F.lit(f"Expecting {kind} but was "), found["text"], F.lit(" at "), found["line"].cast("string"), F.lit(":"), found["col"].cast("string"))
    return value, F.when(found["text"].isNotNull() & value.isNull(), why)


def records(tags_: DataFrame, keys: list[str], fields: dict[str, Part], *path: str | None, name: str = "tag") -> DataFrame:
    """(keys, tag, fields, error): one row for each tag at a path from the root (its number), with typed fields.

    A tag without a required field is left out, unless there is an error; a value
    that doesn't convert is an error that tells its place, and hides the fields. Of a
    repeated tag the last counts, or with ``many`` all in order (without bodies: none).
    """
    row = F.col(name)
    is_own, is_child = at_path(row, *path), at_path(row, *path, None)
    own = F.get(row["opened"], F.lit(len(path) - 1))
    rows = tags_.where(is_own | is_child).select(*keys, own.alias("_tag"), is_own.alias("_own"), row.alias("_row"))
    r = F.col("_row")
    aggregates = []
    for field, part in fields.items():
        if part.attribute:
            found = F.struct(attribute(r, part.name).alias("text"), r["line"].alias("line"), r["col"].alias("col"))
            aggregates.append(F.max(F.when(F.col("_own"), found)).alias(field))
        else:
            found = F.struct(r["nr"].alias("nr"), r["text"].alias("text"), r["text_line"].alias("line"), r["text_col"].alias("col"))
            some = F.when(~F.col("_own") & (r["name"] == part.name) & r["text"].isNotNull(), found)
            aggregates.append((F.array_sort(F.collect_list(some)) if part.many else F.max(some)).alias(field))
    made = rows.groupBy(*keys, "_tag").agg(F.max("_own").alias("_own"), *aggregates).where("_own")
    values, errors, needed = {}, [], F.lit(True)
    for field, part in fields.items():
        if part.many:
            both = partial(_typed, kind=part.kind)
            values[field] = F.transform(field, lambda x: both(x)[0])  # noqa: B023
            errors.append(F.filter(F.transform(field, lambda x: both(x)[1]), lambda e: e.isNotNull()))  # noqa: B023
        else:
            values[field], wrong = _typed(F.col(field), part.kind)
            errors.append(F.when(wrong.isNotNull(), F.array(wrong)).otherwise(F.array().cast("array<string>")))
            needed = needed if part.optional else needed & values[field].isNotNull()
    error = F.nullif(F.array_join(F.concat(*errors), "; "), F.lit(""))
    made = made.select(*keys, F.col("_tag").alias(name), *(F.when(error.isNull(), v).alias(f) for f, v in values.items()), error.alias("error"), needed.alias("_needed"))
    return made.where("_needed or error is not null").drop("_needed")


# Writing


class _Scope:
    """Prefixes as they stand within a tag."""

    def __init__(self, known: dict[str, str]):
        self.known, self.own, self.fresh = dict(known), {}, 0

    def declare(self, prefix: str, space: str) -> None:
        if self.known.get(prefix, "") != space:
            self.own[prefix] = self.known[prefix] = space

    def prefix(self, wanted: str, space: str, attribute: bool) -> str:
        """A prefix that stands for a namespace here: the wanted one if it is free on this tag."""
        if space == XML:
            return "xml"
        if not space:
            if attribute:
                return ""
            wanted = ""
        elif attribute and not wanted:
            wanted = next((p for p, s in self.known.items() if p and s == space), "")
        if (wanted or not attribute or not space) and self.known.get(wanted, "") == space:
            return wanted
        if (attribute and not wanted) or (wanted in self.own and self.own[wanted] != space) or wanted in ("xml", "xmlns"):
            while (wanted := f"ns{self.fresh}") in self.known:
                self.fresh += 1
        self.declare(wanted, space)
        return wanted


def _tagged(prefix: str, name: str) -> str:
    local = name.rpartition("}")[2]
    return f"{prefix}:{local}" if prefix else local


def _space(name: str) -> str:
    return name[1:].rpartition("}")[0] if name.startswith("{") else ""


def written_text(rows: Iterator[dict]) -> str:
    """The document of a sequence of events; declarations that a tag lacks are added, those that hold already are dropped."""
    out, scopes, names, open_ = [], [_Scope({})], [], False
    for e in rows:
        if open_:
            out.append("/>" if e["kind"] == "end" else ">")
        if e["kind"] == "start":
            scope = _Scope(scopes[-1].known)
            name = _tagged(scope.prefix(e["prefix"] or "", _space(e["name"]), False), e["name"])
            attributes = [(_tagged(scope.prefix(a["prefix"] or "", _space(a["name"]), True), a["name"]), a["value"]) for a in e["attributes"] or []]
            for n in e["namespaces"] or []:
                if n["prefix"] not in scope.own:
                    scope.declare(n["prefix"], n["space"])
            declared = [(f"xmlns:{p}" if p else "xmlns", s) for p, s in scope.own.items()]
            out.append(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in [*declared, *attributes]))
            scopes.append(scope)
            names.append(name)
        elif e["kind"] == "end":
            name = names.pop()
            scopes.pop()
            if not open_:
                out.append(f"</{name}>")
        elif e["kind"] == "text":
            out.append(escape(e["text"]).replace("\r", "&#13;"))
        else:
            raise ValueError(e["text"])
        open_ = e["kind"] == "start"
    return "".join(out)


def documents(events_: DataFrame, keys: list[str], name: str = "event", column: str = "doc") -> DataFrame:
    """(keys, column): the events of each key, in order of their numbers, as a document again.

    Any balanced part of a document does, such as what sub_tag selects. A group
    is one document, put together in one task; a malformed one is an error.
    """
    rows = events_.select(*keys, F.col(name).alias("_event"))
    schema = StructType([*rows.select(*keys).schema.fields, StructField(column, StringType())])

    def run(part: pa.Table) -> pa.Table:
        held = sorted(part.column("_event").to_pylist(), key=lambda e: e["nr"])
        return part.select(keys).slice(0, 1).append_column(column, pa.array([written_text(held)], pa.string()))

    return rows.groupBy(*keys).applyInArrow(run, schema)
