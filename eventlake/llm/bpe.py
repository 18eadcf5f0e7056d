"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import need_columns

#: Code points a text is encoded in at once; rows and bytes of text or ids that are taken from a batch and go back to Spark at once.
PIECE, ROWS, BYTES = 1 << 16, 1000, 1 << 22
#: Behind any character that isn't white space, a space or line feed always starts a new
#: match of the pre-splitting pattern: no match goes on from another character to white space.
_SAFE = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes and rank a line), without special tokens; once a worker."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of at least ``size`` code points, cut at safe boundaries only; together they are the text."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def packed(enc: tiktoken.Encoding, text: str | None, bits: int = 32, never: int | None = None) -> bytes:
    """The ids of a text as little-endian integers of so many bits; an id that doesn't fit, or is ``never``, is an error."""
    if not text:
        return b""
    ids = encode_text(enc, text)
    if bits == 16 and (ids.max() >= 1 << 16 or (never is not None and (ids == never).any())):
        raise ValueError("an id is the separator's or needs more than 16 bits")
    return ids.astype("<u2" if bits == 16 else "<u4").tobytes()


def unpacked(enc: tiktoken.Encoding, ids: bytes | None) -> bytes:
    """The bytes that packed 32-bit ids stand for."""
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist()) if ids else b""


def _slices(rows: Iterator[pa.RecordBatch], column: str, most: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of few rows and few bytes in a column (one row at least); no value leaves Arrow here."""
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            held = int(total[first - 1]) if first else 0
            last = min(first + most, max(first + 1, int(np.searchsorted(total, held + size, "right"))))
            yield batch.slice(first, last - first)
            first = last


def _added(df: DataFrame, source: str, keep: list[str] | None, made: dict[str, Callable], ranks: str, pattern: str) -> DataFrame:
    """df (its columns ``keep``, all by default) with binary columns, each a function of the encoding and of source or of the column made before it: one pass."""
    stay = [c for c in (df.columns if keep is None else keep) if c not in made]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for part in _slices(rows, source):
            out = []
            values = part.column(source)
            for f in made.values():
                values = pa.array((f(enc, v.as_py()) for v in values), pa.binary())
                out.append(values)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *out], [*stay, *made])

    need = list(dict.fromkeys([*stay, source]))
    kinds = [f for f in df.select(*stay).schema.fields] if stay else []
    return df.select(*need).mapInArrow(run, StructType([*kinds, *(StructField(c, BinaryType()) for c in made)]))


def encode(
    docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bits: int = 32, never: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """docs with ids_col: the token ids of each whole text, packed as little-endian unsigned integers of 32 bits (or 16).

    Null and empty texts have no ids (an empty value). Texts of any length are
    split at safe boundaries first, so the result is the whole text's. Strings
    of special tokens are ordinary text. With 16 bits an id that needs more, or
    equals ``never`` (a separator), is an error. Other columns stay as they are,
    or only those named in keep; a column named ids_col is replaced. Rows are
    handled one by one: ties, repeated rows and empty tables need no rule.
    """
    need_columns(docs, text_col)
    return _added(docs, text_col, keep, {ids_col: lambda enc, t: packed(enc, t, bits, never)}, ranks, pattern)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """tokens with bytes_col: the raw bytes that each row's packed 32-bit ids stand for.

    Bytes, not text: ids may be cut within a character. Null or empty ids give
    empty bytes; an id without a rank is an error. A column named bytes_col is
    replaced, all others stay, or only those named in keep.
    """
    need_columns(tokens, ids_col)
    return _added(tokens, ids_col, keep, {bytes_col: unpacked}, ranks, pattern)


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """docs with both encode's ids_col and decode's bytes_col of those very ids, in one pass through Python.

    The rules of both hold; columns of these two names are replaced.
    """
    need_columns(docs, text_col)
    return _added(docs, text_col, keep, {ids_col: packed, bytes_col: unpacked}, ranks, pattern)


def n_tokens(ids_col: str = "ids"):
    """Column: how many ids a packed 32-bit value holds."""
    return F.expr(f"cast(octet_length(`{ids_col}`) div 4 as bigint)")
