"""Length-delimited binary messages: a varint length, then so many bytes; and event envelopes in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST = (1 << 31) - 1


def varint(n: int) -> bytes:
    """Seven bits a byte, lowest first; negative numbers as their 64-bit two's complement, in ten bytes."""
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); an error for one that is cut off or has ten bytes or more."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise ValueError("the data end within a length")
        b = data[at + i]
        value |= (b & 127) << 7 * i
        if b < 128:
            return value, at + i + 1
    raise ValueError("malformed length")


def frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        n, at = read_varint(data, at)
        if n > MOST or at + n > len(data):
            raise ValueError(f"a message of {n} bytes is too long or cut off")
        yield data[at : at + n]
        at += n


def signed(n: int) -> int:
    """A varint's value as a 64-bit number with a sign."""
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def encode_envelope(pid: str, nr: int, ms: int, event: bytes) -> bytes:
    name = pid.encode()
    return b"\x0a" + varint(len(name)) + name + b"\x10" + varint(nr) + b"\x18" + varint(ms) + b"\x22" + varint(len(event)) + event


def decode_envelope(data: bytes) -> tuple[str, int, int, bytes]:
    """Fields in any order; unknown ones are passed over, missing ones are empty."""
    found: dict[int, object] = {1: b"", 2: 0, 3: 0, 4: b""}
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 0:
            found[key >> 3], at = read_varint(data, at)
        elif key & 7 == 2:
            n, at = read_varint(data, at)
            found[key >> 3], at = data[at : at + n], at + n
        elif key & 7 in (1, 5):
            at += 8 if key & 7 == 1 else 4
        else:
            raise ValueError(f"unknown wire type {key & 7}")
    return bytes(found[1]).decode(), signed(found[2]), signed(found[3]), bytes(found[4])


def _delimited(pid: pd.Series, nr: pd.Series, ms: pd.Series, event: pd.Series) -> pd.Series:
    made = (encode_envelope(p, int(n), int(m), e) for p, n, m, e in zip(pid, nr, ms, event))
    return pd.Series([varint(len(x)) + x for x in made])


def envelope_frame(pid: Column | str, nr: Column | str, ms: Column | str, event: Column | str) -> Column:
    """Each row's envelope as one delimited message; null parts are written as empty text, 0 and no bytes."""
    known = lambda c, kind, empty: F.coalesce((F.col(c) if isinstance(c, str) else c).cast(kind), empty)
    return F.pandas_udf(_delimited, "binary")(known(pid, "string", F.lit("")), known(nr, "long", F.lit(0)), known(ms, "long", F.lit(0)), known(event, "binary", F.lit(b"")))


ENVELOPE_SCHEMA = "persistence_id string, sequence_nr long, timestamp_ms long, event binary"


def decode_frames(files: DataFrame, content: str = "content", rows: int = 5000) -> DataFrame:
    """The envelopes in a column of delimited messages, in bounded batches; null and empty contents hold none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for data in part.column(0):
                for message in frames(data.as_py() or b""):
                    held.append(decode_envelope(message))
                    if len(held) >= rows:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)

    return files.select(F.col(content).cast("binary")).mapInArrow(run, ENVELOPE_SCHEMA)


def decode_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """messages with the envelope's columns in place of a column of bare messages (without their lengths); null is an empty envelope."""
    stay = [c for c in messages.columns if c != column]
    kinds = StructType([*messages.select(*stay).schema.fields, *StructType.fromDDL(ENVELOPE_SCHEMA).fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                made = _batch([decode_envelope(v.as_py() or b"") for v in part.column(column)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), *made.columns], [*stay, *made.schema.names])

    return messages.mapInArrow(run, kinds)


class Deframer:
    """Messages out of the chunks of one byte stream, cut anywhere; what a chunk leaves unfinished waits for the next one."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        data, at = self.rest + chunk, 0
        while at < len(data):
            head = data[at : at + 10]
            if all(b > 127 for b in head) and len(head) < 10:
                break  # the length itself is cut
            n, start = read_varint(data, at)
            if n > MOST:
                raise ValueError(f"a message of {n} bytes is too long")
            if start + n > len(data):
                break
            yield data[start : start + n]
            at = start + n
        self.rest = data[at:]

    def end(self) -> None:
        if self.rest:
            raise ValueError(f"the stream ends within a message, {len(self.rest)} bytes of it are there")


def decode_chunks(chunks: DataFrame, stream: str, order: str, content: str = "content", rows: int = 5000) -> DataFrame:
    """(stream, place, envelope columns): the envelopes in byte streams that come as rows of chunks, each cut anywhere.

    Chunks follow each other by ``order``, place counts a stream's messages from 0. A
    stream goes through one task, chunk by chunk; only an unfinished message is
    held. Null and empty chunks hold nothing, rows with a null stream are left out. A
    stream that ends within a message is an error.
    """
    dealt = chunks.where(F.col(stream).isNotNull()).select(F.col(stream).alias("stream"), F.col(order).alias("nr"), F.col(content).cast("binary").alias("content"))
    dealt = dealt.repartition("stream").sortWithinPartitions("stream", "nr").select("stream", "content")
    kind = dealt.schema["stream"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names: list[object] = []
        current, deframer, place = None, Deframer(), 0

        def out(like: pa.DataType) -> pa.RecordBatch:
            streams, places = zip(*names)
            made = _batch(held)
            return pa.RecordBatch.from_arrays([pa.array(streams, like), pa.array(places, pa.int64()), *made.columns], ["stream", "place", *made.schema.names])

        for part in parts:
            for name, data in zip(part.column(0).to_pylist(), part.column(1)):
                if name != current:
                    deframer.end()
                    current, deframer, place = name, Deframer(), 0
                for message in deframer.feed(data.as_py() or b""):
                    held.append(decode_envelope(message))
                    names.append((name, place))
                    place += 1
                if len(held) >= rows:
                    yield out(part.column(0).type)
                    held, names = [], []
            if held:
                yield out(part.column(0).type)
                held, names = [], []
        deframer.end()

    return dealt.mapInArrow(run, f"stream {kind}, place long, {ENVELOPE_SCHEMA}").withColumnRenamed("stream", stream)


def concatenated(chunks: DataFrame, keys: list[str], order: str, content: str = "content") -> DataFrame:
    """(keys, content): the chunks of each key put together in order; null chunks add nothing, a key with no others has no content (null)."""
    whole = F.expr(f"listagg(`{content}`) within group (order by `{order}`)")
    return chunks.withColumn(content, F.col(content).cast("binary")).groupBy(*keys).agg(whole.alias(content))


def cut(df: DataFrame, content: str, size: int, order: str = "nr") -> DataFrame:
    """df with one row for each ``size`` bytes of a column, numbered from 0; empty and null contents give none."""
    own = F.col(content)
    starts = F.when(F.octet_length(own) > 0, F.sequence(F.lit(1), F.octet_length(own), F.lit(size)))
    each = df.select(*(c for c in df.columns if c not in (content, order)), own, F.posexplode(starts).alias(order, "_start"))
    return each.withColumn(content, F.substring(own, F.col("_start"), F.lit(size))).drop("_start")


def _batch(envelopes: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["persistence_id", "sequence_nr", "timestamp_ms", "event"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*envelopes), kinds)], names)
