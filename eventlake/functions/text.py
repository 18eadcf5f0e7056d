"""Text and byte functions: full-match patterns, base64, character sets, located casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of a pattern that the whole text must match; null if it doesn't."""
    whole = f"^(?:{pattern})$"
    return F.when(text.rlike(whole), F.regexp_extract(text, whole, group))


def must_match(text: Column, pattern: str) -> Column:
    """The text, or an error if it isn't a full match."""
    return F.when(text.isNull() | text.rlike(f"^(?:{pattern})$"), text).otherwise(F.raise_error(F.concat(text, F.lit(f" should match {pattern}"))).cast("string"))


def base64_line(data: Column) -> Column:
    """Base64 in one line (the built-in breaks lines every 76 characters)."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 text, white space skipped; null if it is malformed."""
    return F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64"))


#: UTF-16 units as hexadecimal digits: one that stands alone, the first and the second of a pair; high byte first.
_UNIT, _HIGH, _LOW = ("[0-9A-CEF][0-9A-F]|D[0-7]", "[0-9A-F]{2}"), ("D[89AB]", "[0-9A-F]{2}"), ("D[C-F]", "[0-9A-F]{2}")
#: The last character of sets that have the first so many of Unicode.
_LAST = {"US-ASCII": 0x7F, "ISO-8859-1": 0xFF}


def _utf16(big: bool) -> str:
    unit, high, low = (f"(?:{a}){b}" if big else f"{b}(?:{a})" for a, b in (_UNIT, _HIGH, _LOW))
    return f"^(?:{unit}|{high}{low})*+$"


def decodable(data: Column, charset: str) -> Column:
    """Whether bytes are whole and well-formed text of US-ASCII, ISO-8859-1, UTF-8, UTF-16, UTF-16BE or UTF-16LE; UTF-16 goes by its byte order mark, else high byte first."""
    name = charset.upper()
    if name == "UTF-8":
        return F.is_valid_utf8(data.cast("string"))
    if name in ("UTF-16BE", "UTF-16LE"):
        return F.hex(data).rlike(_utf16(name == "UTF-16BE"))
    if name == "UTF-16":
        return F.when(F.hex(data).startswith("FFFE"), F.hex(data).rlike(_utf16(False))).otherwise(F.hex(data).rlike(_utf16(True)))
    if name == "US-ASCII":
        return F.hex(data).rlike("^(?:[0-7][0-9A-F])*+$")
    if name == "ISO-8859-1":
        return data.isNotNull() | F.lit(None).cast("boolean")
    raise ValueError(f"unknown character set {charset}")


def encodable(text: Column, charset: str) -> Column:
    """Whether a character set has all characters of a text."""
    last = _LAST.get(charset.upper())
    return text.isNotNull() | F.lit(None).cast("boolean") if last is None else ~text.rlike(rf"[^\x{{0}}-\x{{{last:X}}}]")


def decode_strict(data: Column, charset: str) -> Column:
    """Text of bytes in a character set; an error for malformed or cut-off input."""
    wrong = F.raise_error(F.concat(F.lit(f"malformed {charset}, from its "), F.octet_length(data).cast("string"), F.lit(" bytes"))).cast("string")
    return F.when(data.isNotNull(), F.when(decodable(data, charset), F.decode(data, charset)).otherwise(wrong))


def try_decode(data: Column, charset: str) -> Column:
    """Text of bytes in a character set; null for malformed or cut-off input."""
    return F.when(decodable(data, charset), F.decode(data, charset))


def encode_strict(text: Column, charset: str) -> Column:
    """Bytes of a text; an error for characters that the set lacks."""
    wrong = F.raise_error(F.lit(f"a character isn't in {charset}")).cast("binary")
    return F.when(text.isNotNull(), F.when(encodable(text, charset), F.encode(text, charset)).otherwise(wrong))


def try_encode(text: Column, charset: str) -> Column:
    """Bytes of a text; null if the set lacks one of its characters."""
    return F.when(encodable(text, charset), F.encode(text, charset))


def parsed(text: Column, kind: str, where: Column | None = None) -> tuple[Column, Column]:
    """(value, error) of a typed cast: the error tells what was expected, what was there, and where."""
    value = F.trim(text).try_cast(kind)
    at = F.lit("") if where is None else F.concat(F.lit(" at "), where)
    error = F.when(text.isNotNull() & value.isNull(), F.concat(F.lit(f"Expecting {kind} but was "), text, at))
    return value, error
