"""Simple types of XML Schema as checks of text columns: built-in types, facets, lists and unions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "http://www.w3.org/2001/XMLSchema"
Name = tuple[str, str]


@dataclass(frozen=True)
class SimpleType:
    """A type restricted by facets, or a list of items, or a union of members."""

    base: Name | SimpleType | None = None
    facets: tuple[tuple[str, str], ...] = ()
    item: Name | SimpleType | None = None
    members: tuple[Name | SimpleType, ...] = ()


# The lexical forms that the XML Schema recommendation gives its built-in types.
ZONE = r"(Z|[+-]((0\d|1[0-3]):[0-5]\d|14:00))?"
CLOCK = r"(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)"
NAME_START, NAME_MORE = r"\p{L}_", r"\p{L}\p{M}\p{N}_.\-\x{b7}"
NCNAME = f"[{NAME_START}][{NAME_MORE}]*"
FORMS = {
    "boolean": "true|false|1|0",
    "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)",
    "integer": r"[+-]?\d+",
    "float": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN",
    "date": r"-?\d{4,}-\d\d-\d\d" + ZONE,
    "time": CLOCK + ZONE,
    "dateTime": r"-?\d{4,}-\d\d-\d\dT" + CLOCK + ZONE,
    "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
    "gYear": r"-?\d{4,}" + ZONE,
    "gYearMonth": r"-?\d{4,}-(0[1-9]|1[0-2])" + ZONE,
    "gMonth": "--(0[1-9]|1[0-2])" + ZONE,
    "gMonthDay": r"--(02-(0[1-9]|[12]\d)|(0[469]|11)-(0[1-9]|[12]\d|30)|(0[13578]|1[02])-(0[1-9]|[12]\d|3[01]))" + ZONE,
    "gDay": r"---(0[1-9]|[12]\d|3[01])" + ZONE,
    "base64Binary": "([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?",
    "hexBinary": "([0-9a-fA-F]{2})*",
    "language": "[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
    "Name": f"[{NAME_START}:][{NAME_MORE}:]*",
    "NCName": NCNAME,
    "QName": f"({NCNAME}:)?{NCNAME}",
    "NMTOKEN": f"[{NAME_MORE}:]+",
}
#: Built-in types that have another one's form, and whole numbers' bounds.
LIKE = {"double": "float", "ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName", "NOTATION": "QName"}
BOUNDS = {
    "integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "long": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "short": (-(1 << 15), (1 << 15) - 1), "byte": (-128, 127),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedByte": (0, 255),
}
LISTS = {"IDREFS": "IDREF", "ENTITIES": "ENTITY", "NMTOKENS": "NMTOKEN"}
WHOLE = "decimal(38,0)"


def _full(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})\z")


def _collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n]+", " "), "^ | $", "")


def _within(text: Column, low: int | None, high: int | None) -> Column:
    """Whether a whole number lies within bounds; one beyond 38 digits lies above (or, negative, below) all of them."""
    number = text.try_cast(WHOLE)
    far = F.when(text.startswith("-"), F.lit(low is None)).otherwise(F.lit(high is None))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (number >= F.lit(str(low)).cast(WHOLE))
    if high is not None:
        ok = ok & (number <= F.lit(str(high)).cast(WHOLE))
    return F.when(number.isNull(), far).otherwise(ok)


def _built_in(text: Column, name: str) -> Column:
    """Whether collapsed text is of a built-in type; strings are of any text."""
    if name in BOUNDS:
        return _full(text, FORMS["integer"]) & _within(text, *BOUNDS[name])
    if name == "base64Binary":
        return _full(F.replace(text, F.lit(" "), F.lit("")), FORMS[name])
    form = FORMS.get(LIKE.get(name, name))
    if form is None:
        return F.lit(True)
    ok = _full(text, form)
    if name in ("date", "dateTime"):  # a day that is there; signs stand before years
        day = F.regexp_extract(text, r"^-?(\d{4,}-\d\d-\d\d)", 1)
        ok = ok & day.try_cast("date").isNotNull()
    return ok


def _spaced(text: Column, how: str) -> Column:
    return text if how == "preserve" else F.regexp_replace(text, r"[\t\r\n]", " ") if how == "replace" else _collapsed(text)


def _root(kind: Name | SimpleType, named: dict[Name, SimpleType]) -> str:
    """The built-in type that an atomic type comes from; "" for a list or union."""
    while True:
        if isinstance(kind, tuple):
            if kind[0] == SPACE:
                return "" if kind[1] in LISTS else kind[1]
            kind = named[kind]
        if kind.item is not None or kind.members:
            return ""
        kind = kind.base


def _space(kind: Name | SimpleType, named: dict[Name, SimpleType]) -> str:
    """What becomes of white space: the nearest facet that tells it, else the built-in type's way."""
    while isinstance(kind, SimpleType) or kind[0] != SPACE:
        own = named[kind] if isinstance(kind, tuple) else kind
        told = dict(own.facets).get("whiteSpace")
        if told:
            return told
        if own.base is None:
            return "collapse"
        kind = own.base
    return {"string": "preserve", "anySimpleType": "preserve", "anyType": "preserve", "normalizedString": "replace"}.get(kind[1], "collapse")


def _items(kind: Name | SimpleType, named: dict[Name, SimpleType]) -> bool:
    """Whether values are lists."""
    while isinstance(kind, SimpleType) or kind[0] != SPACE:
        own = named[kind] if isinstance(kind, tuple) else kind
        if own.item is not None or own.base is None:
            return own.item is not None
        kind = own.base
    return kind[1] in LISTS


def _ordered(root: str):
    """How values of a built-in type are compared."""
    if root in ("float", "double"):
        return lambda c: F.replace(c, F.lit("INF"), F.lit("Infinity")).try_cast("double")
    if root == "date":
        return lambda c: F.substring(c, 1, 10).try_cast("date")
    if root == "dateTime":
        return lambda c: c.try_cast("timestamp")
    if root == "time":
        return lambda c: F.concat(F.lit("2000-01-01T"), c).try_cast("timestamp")
    return lambda c: c.try_cast("decimal(38,18)") if root == "decimal" else c.try_cast(WHOLE)


def _facet(text: Column, facet: str, value: str, root: str, items: bool) -> Column | None:
    if facet in ("length", "minLength", "maxLength"):
        size = F.when(text == "", 0).otherwise(F.size(F.split(text, " "))) if items else F.length(text)
        if root == "hexBinary":
            size = F.length(text) / 2
        elif root == "base64Binary":
            size = F.length(F.regexp_replace(text, "[ =]", "")) * 3 / 4
            size = F.floor(size)
        return size == int(value) if facet == "length" else size >= int(value) if facet == "minLength" else size <= int(value)
    if facet in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"):
        own, bound = _ordered(root)(text), _ordered(root)(F.lit(value))
        far = F.lit(facet.startswith("max")) if root in BOUNDS else F.lit(False)  # beyond 38 digits
        far = F.when(text.startswith("-"), far).otherwise(~far) if root in BOUNDS else far
        held = {"minInclusive": own >= bound, "minExclusive": own > bound, "maxInclusive": own <= bound, "maxExclusive": own < bound}[facet]
        return F.coalesce(held, far)
    digits = F.regexp_replace(F.regexp_replace(text, r"^[+-]?0*", ""), r"(\.\d*?)0*$", "$1")
    if facet == "totalDigits":
        return F.length(F.replace(digits, F.lit("."), F.lit(""))) <= int(value)
    if facet == "fractionDigits":
        return F.length(F.regexp_extract(digits, r"\.(\d*)$", 1)) <= int(value)
    return None


def _facets(text: Column, kind: SimpleType, root: str, items: bool) -> Column:
    """Whether text keeps to a type's own facets: any of its patterns, any of its enumerated values, all others."""
    ok = F.lit(True)
    patterns = [v for f, v in kind.facets if f == "pattern"]
    if patterns:
        ok = ok & _full(text, "|".join(f"(?:{p})" for p in patterns))
    listed = [v for f, v in kind.facets if f == "enumeration"]
    if listed:
        alike = F.lit(False)
        for v in listed:
            same = text == v
            if root in BOUNDS or root in ("decimal", "float", "double"):
                same = F.coalesce(_ordered(root)(text) == _ordered(root)(F.lit(v)), same)
            alike = alike | same
        ok = ok & alike
    for facet, value in kind.facets:
        held = _facet(text, facet, value, root, items)
        ok = ok if held is None else ok & held
    return ok


def valid(text: Column, kind: Name | SimpleType, named: dict[Name, SimpleType]) -> Column:
    """Whether text is of a simple type, by the XML Schema recommendation; null stays null.

    named are the simple types that a schema defines. Dates are compared without their
    zones, patterns are Java's, without the escapes for characters of names.
    """
    return F.when(text.isNotNull(), _valid(_spaced(text, _space(kind, named)), kind, named))


def _valid(text: Column, kind: Name | SimpleType, named: dict[Name, SimpleType]) -> Column:
    if isinstance(kind, tuple):
        if kind[0] != SPACE:
            return _valid(text, named[kind], named) if kind in named else F.lit(True)
        if kind[1] in LISTS:
            return (text != "") & F.forall(F.split(text, " "), lambda x: _built_in(x, LISTS[kind[1]]))
        return _built_in(text, kind[1])
    if kind.item is not None:
        return F.when(text == "", F.lit(True)).otherwise(F.forall(F.split(text, " "), lambda x: _valid(x, kind.item, named)))
    if kind.members:
        ok = F.lit(False)
        for m in kind.members:
            ok = ok | valid(text, m, named)
        return ok
    if kind.base is None:
        return F.lit(True)
    return _valid(text, kind.base, named) & _facets(text, kind, _root(kind, named), _items(kind, named))
