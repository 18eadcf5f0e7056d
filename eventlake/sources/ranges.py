"""Files of delimited messages, however large, read by many tasks.

Where a message begins in the middle of a file depends on all before it. So each
piece of a file is looked at from every start that it might have: where the chain of
messages from there leaves the piece. Chains soon meet, so most starts of a piece have
one of a few exits; these are tried as entries, and following them from the start of
the file, a step a piece, tells the true ones. A file whose true chain leaves them is
followed once more through the exits of all starts, which are all the entries that
there can be. Then pieces are read on their own, and messages that cross pieces are
put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written
from .framing import MOST, read_varint

#: Bytes of a piece, and the most that a length can take.
PIECE, LONGEST = 1 << 20, 10
MARK = b"\xef\xbb\xbf"
DEAD = -1
EDGE = "file string, entry long, exit long"
#: Exits of a piece, the commonest ones, that are tried as entries before all are.
GUESSES = 8


def _ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a block as its bytes again, a batch of them at a time."""
    part, here = 0, None
    for batch in rows:
        files, blocks = (batch.column(c).to_pylist() for c in (0, 1))
        first = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (files[i], blocks[i]) != (files[first], blocks[first]):
                part = part + 1 if here == (files[first], blocks[first]) else 0
                here = (files[first], blocks[first])
                data = b"\n".join(v.as_py() for v in batch.column(2).slice(first, i - first)) + b"\n"
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((here[0], pa.string()), (here[1], pa.int64()), (part, pa.int64()), (data, pa.binary()))], ["file", "block", "part", "data"])
                first = i


def pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(file, piece, content, total): the files below path in pieces of ``size`` bytes, numbered from 0; total is the file's size. Written, as it is read more than once."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    parts = written(lines.mapInArrow(_ranges, "file string, block long, part long, data binary"), "file-ranges")
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("total"))
    order = Window.partitionBy("file").orderBy("block", "part")
    light = parts.select("file", "block", "part", F.octet_length("data").cast("long").alias("n")).join(sizes, "file")
    # the reader leaves out a byte order mark, and a line feed that is the last byte makes no line
    lost = F.when(F.sum("n").over(Window.partitionBy("file")) < F.col("total"), F.lit(len(MARK))).otherwise(F.lit(0))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    light = light.select("file", "block", "part", "total", F.when(before == 0, F.lit(0)).otherwise(before + lost).alias("at"), (lost + before).alias("own"))
    placed = parts.join(light, ["file", "block", "part"])
    data = F.when(F.col("at") != F.col("own"), F.concat(F.lit(MARK), F.col("data"))).otherwise(F.col("data"))
    placed = placed.select("file", "total", "at", F.substring(data, F.lit(1), (F.col("total") - F.col("at")).cast("int")).alias("data"))
    cuts = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.octet_length("data") - 1) / size))
    each = placed.where(F.octet_length("data") > 0).select("file", "total", "at", "data", F.explode(cuts).alias("piece"))
    start = F.greatest(F.col("piece") * size, F.col("at"))
    stop = F.least((F.col("piece") + 1) * size, F.col("at") + F.octet_length("data"))
    each = each.select("file", "piece", "total", start.alias("at"), F.substring("data", (start - F.col("at") + 1).cast("int"), (stop - start).cast("int")).alias("data"))
    whole = each.groupBy("file", "piece").agg(F.expr("listagg(data) within group (order by at)").alias("content"), F.max("total").alias("total"))
    return written(whole, "file-pieces")


def steps(data: np.ndarray, n: int, room: int) -> np.ndarray:
    """For each of the first n places of data, taken as a message's start, the place behind that message; DEAD where there can't be one: a bad length, or an end beyond ``room``."""
    value, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.arange(n)
    for i in range(LONGEST):
        open_ = open_[open_ + i < len(data)]
        b = data[open_ + i].astype(np.int64)
        if i < 9:
            value[open_] |= (b & 127) << 7 * i
        else:
            value[open_[(b & 127) > 0]] = MOST + 1
        done = b < 128
        length[open_[done]] = i + 1
        open_ = open_[~done]
    ends = np.arange(n) + length + value
    return np.where((length > 0) & (value >= 0) & (value <= MOST) & (ends <= room), ends, DEAD)


def exits(data: np.ndarray, n: int, room: int) -> np.ndarray:
    """For each start among the first n places of data the first message's start behind them, by doubling steps."""
    to = steps(data, n, room)
    while len(inside := np.flatnonzero((to >= 0) & (to < n))):
        to[inside] = to[to[inside]]
    return to


def _exits(size: int, most: int | None = None):
    """(file, entry, exit) of a piece for its ``entries``; in a table without them the distinct exits of all starts (the ``most`` commonest) within the file, without their entries."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                base, n = r["piece"] * size, len(r["content"])
                data = np.frombuffer(r["content"] + (r["ahead"] or b""), np.uint8)
                to = exits(data, n, r["total"] - base)
                if "entries" in r:
                    entry = np.array(r["entries"], np.int64)
                    exit_ = to[entry - base]
                    exit_ = np.where(exit_ >= 0, exit_ + base, DEAD)
                else:
                    to = to[:1] if base == 0 else to
                    exit_, times = np.unique(to[(to >= 0) & (to < r["total"] - base)], return_counts=True)
                    if most is not None and len(exit_) > most:
                        exit_ = exit_[np.argpartition(times, -most)[-most:]]
                    exit_ = exit_ + base
                    entry = np.full(len(exit_), DEAD)
                for i in range(0, len(entry), 50_000):
                    part = entry[i : i + 50_000], exit_[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(part[0]), pa.string()), *map(pa.array, part)], ["file", "entry", "exit"])

    return run


def _follow(size: int):
    """(file, piece, entry): the true entries of each file, from its start on, exit after exit; DEAD for a piece, with the entry, where the next one isn't among the edges. Edges come by file and entry, and only the place is held."""

    def run(edges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, total, at = None, 0, 0
        for batch in edges:
            found = []
            for f, entry, exit_, n in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "exit", "total"))):
                if f != file:
                    if at < total:
                        found.append((file, DEAD, at))
                    file, total, at = f, n, 0
                if entry == at:
                    found.append((file, at // size, at))
                    if (at := exit_) == DEAD:
                        raise ValueError(f"{file}: a message behind byte {entry} has a bad length or is cut off")
            yield _entries(found)
        yield _entries([(file, DEAD, at)] if at < total else [])

    return run


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "piece", "entry"])


def _true_entries(pieces: DataFrame, able: DataFrame, size: int) -> DataFrame:
    """The true entries of files of pieces, as far as they are among those in able: see _follow."""
    grouped = able.distinct().groupBy("file", F.floor(F.col("entry") / size).alias("piece")).agg(F.collect_list("entry").alias("entries"))
    edges = pieces.join(grouped, ["file", "piece"]).mapInArrow(_exits(size), EDGE)
    edges = edges.join(pieces.where("piece = 0").select("file", "total"), "file").repartition("file").sortWithinPartitions("file", "entry")
    return written(edges.mapInArrow(_follow(size), "file string, piece long, entry long"), "entries")


def _messages(size: int):
    """Of a piece its whole messages (end null), and parts of those that cross its ends (end: where the message ends)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                base, content = r["piece"] * size, r["content"]
                out = []
                at = len(content) if r["entry"] is None else r["entry"] - base
                if at:  # the head belongs to what began in a piece before
                    out.append((base, r["next"] if r["entry"] is None else r["entry"], content[:at]))
                while at < len(content):
                    try:
                        n, start = read_varint(content, at)
                    except ValueError:
                        start = len(content) + 1
                    if start > len(content) or start + n > len(content):
                        out.append((base + at, r["next"], content[at:]))
                        break
                    out.append((base + at, None, content[start : start + n]))
                    at = start + n
                for i in range(0, len(out), 5000):
                    places, ends, data = zip(*out[i : i + 5000])
                    columns = [pa.array([r["file"]] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(ends, pa.int64()), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "at", "end", "message"])

    return run


def _without_length(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        bare = [v[read_varint(v, 0)[1] :] for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bare, pa.binary())], ["file", "at", "message"])


def messages(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """(file, at, message): all messages of the files below path, and where in its file each begins (with its length).

    A file is many tasks: pieces of ``size`` bytes (10 at least). Only entries of a
    file's pieces go through one task, in order, which holds one number: up to ``GUESSES``
    a piece, and in files whose true chain leaves these all that there can be, which may
    be some for each message. Empty files hold no
    messages; a file that ends within a message, or with a bad length on the way, is an error.
    Spark's text reader finds the ranges, so what lies between two line feeds is held whole.
    """
    if size < LONGEST:
        raise ValueError(f"a piece has {LONGEST} bytes at least")
    each = pieces(spark, path, size)
    heads = each.select("file", (F.col("piece") - 1).alias("piece"), F.substring("content", 1, LONGEST).alias("ahead"))
    known = each.join(heads, ["file", "piece"], "left").select("file", "piece", "content", "total", "ahead")
    start = each.select("file", F.lit(0).cast("long").alias("entry")).distinct()
    able = lambda pieces, most: pieces.mapInArrow(_exits(size, most), EDGE).select("file", F.col("exit").alias("entry")).union(start)
    true = _true_entries(known, able(known, GUESSES), size)
    left = true.where(F.col("piece") == DEAD).select("file")
    if not left.isEmpty():
        rest = known.join(left, "file", "left_semi")
        true = true.join(left, "file", "left_anti").unionByName(_true_entries(rest, able(rest, None), size))
    later = Window.partitionBy("file").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    marked = each.select("file", "piece", "total").join(true, ["file", "piece"], "left")
    following = F.last("entry", ignorenulls=True).over(later)
    marked = written(marked.select("file", "piece", "entry", F.coalesce(following, "total").alias("next")), "true-entries")
    found = written(each.select("file", "piece", "content").join(marked, ["file", "piece"]).mapInArrow(_messages(size), "file string, at long, end long, message binary"), "messages")
    crossing = found.where("end is not null").groupBy("file", "end").agg(F.min("at").alias("at"), F.expr("listagg(message) within group (order by at)").alias("message"))
    crossing = crossing.select("file", "at", "message").mapInArrow(_without_length, "file string, at long, message binary")
    return found.where("end is null").select("file", "at", "message").unionByName(crossing)
