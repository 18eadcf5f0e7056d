"""Token ids in binary files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A folder holds ``codes`` (a table of each id's code length, from the counts of the
whole corpus) and ``data``: binary files of chunks, each ended by a line feed. A
chunk is a head, its documents' ids and lengths, the bit offset at which each block
of ``BLOCK`` ids begins, and the codes, one behind the other. Blocks are decoded
side by side, as the offsets tell where each begins, and any part of a chunk
without what stands before it. Files are numbered in ascending order of documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BYTES, ROWS, _slices, pieces
from .shared import need_columns, written

#: Ids of a block and of a chunk (longer documents are a chunk of their own), chunks of a file, and ids of a partition when files are written.
BLOCK, CHUNK, CHUNKS_A_FILE, PART = 256, 1 << 18, 32, 1 << 22
#: Longest code (more where there are too many ids for it), and how many different ids there may be.
LIMIT, SYMBOLS = 18, 1 << 22
#: Distinct words whose ids a worker remembers, and new ones that are encoded together.
WORDS, LINES = 3 << 19, 4096
#: White space besides space and line feed, and the mark that words are cut by.
_ODD = r"[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEAD, MAGIC = struct.Struct("<4sqqIIIQ"), b"HUF1"


# Encoding


def _marked(texts: pa.Array) -> pa.Array:
    """Texts with a mark before each space or line feed that doesn't follow another one (or, where it does no harm, the start)."""
    for mark, place in ((" ", "\0 "), ("\n", "\0\n"), (" \0", " "), ("\n\0", "\n")):
        texts = pc.replace_substring(texts, mark, place)
    return texts


class Words:
    """A tokenizer of the tokenizers library that encodes each distinct word of many texts once.

    Words end where the byte-level pre-tokenizer always begins a new piece: at a
    space or line feed behind anything that isn't white space. Words not met before
    are encoded together, a line each, and told apart by their tokens' bytes: a line
    feed between two of them is always a token of its own. Texts with other white
    space are cut more carefully (see bpe.pieces) and encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]  # byte-level: a character a byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) of words without white space but one leading space."""
        (ids,) = self._encoded(["\n".join(words.to_pylist())])
        ends = np.cumsum(self.bytes[ids])
        stops = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
        last = np.searchsorted(ends, stops)
        if (ends[last] != stops).any():
            raise ValueError("a token reaches over the end of a line")
        keep = np.ones(len(ids), bool)
        keep[last[:-1] + 1] = False  # the line feeds
        return ids[keep], np.diff(last, prepend=-2) - 1

    def _learn(self, words: list[str]) -> None:
        all_ = pa.array(words, pa.string())
        fits = pc.match_substring_regex(all_, r"^ ?[^ \n]+\z")
        plain, odd = all_.filter(fits), all_.filter(pc.invert(fits)).to_pylist()
        found = [self._lines(plain.slice(i, LINES)) for i in range(0, len(plain), LINES)]
        found += [(ids, np.array([len(ids)])) for ids in self._encoded(odd)]
        size = np.concatenate([n for _, n in found])
        self.known.update(zip([*plain.to_pylist(), *odd], range(len(self.known), len(self.known) + len(words))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and each one's bounds in them (one more than texts); null has none."""
        if len(self.known) > WORDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        split = pc.split_pattern(_marked(pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts), "\0")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self._learn(new)
            known[missing] = [self.known[w] for w in new]
        which = coded.indices.to_numpy()
        size, first = self.size[known][which], self.first[known][which]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.arange(ends[-1], dtype=np.int32)  # a batch is bounded
        place += np.repeat((first - ends[:-1]).astype(np.int32), size)
        ids = self.ids[place]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])]
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(strange):
            parts = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            for i in strange.tolist():
                parts[i] = np.concatenate(self._encoded(list(pieces(texts[i].as_py()))))
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _type(bits: int) -> str:
    return {16: "<u2", 32: "<u4"}[bits]


def encode(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", bits: int = 32) -> DataFrame:
    """(id, ids): each whole text's ids by a tokenizer file, without special tokens, and the end id; packed as little-endian integers of 32 bits (or 16).

    Null and empty texts have the end id only. With 16 bits an id that needs more
    is an error. A null document id stays null. Rows are encoded one by one: ties,
    repeated rows and empty tables need no rule; other columns are ignored.
    """
    need_columns(docs, id_col, text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for part in _slices(rows, "text", 4 * ROWS, 4 * BYTES):
            ids, bounds = words.encode(part.column("text"))
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            if bits == 16 and ids.max() >= 1 << 16:
                raise ValueError("an id needs more than 16 bits")
            # each text's end id moves all that follow it
            places = pa.py_buffer(((bounds + np.arange(len(bounds))) * (bits // 8)).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(ids.astype(_type(bits)).tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("id"), packed], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


# Codes


def counts(tokens: DataFrame, ids_col: str = "ids", bits: int = 32) -> DataFrame:
    """(symbol, n) of packed ids; a partition adds its own up first."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for part in _slices(rows, ids_col):
            ids = np.frombuffer(b"".join(v.as_py() or b"" for v in part.column(ids_col)), _type(bits))
            if len(ids):
                if ids.max() >= SYMBOLS:
                    raise ValueError(f"ids must be less than {SYMBOLS}")
                own = np.bincount(ids, minlength=len(total))
                total = own + np.pad(total, (0, len(own) - len(total)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["symbol", "n"])

    return tokens.select(ids_col).mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def code_lengths(n: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix codes of at most ``limit`` bits (package-merge); more bits where there are too many symbols for them."""
    size = len(n)
    if size <= 1:
        return np.ones(size, np.int64)
    limit = max(limit, (size - 1).bit_length())
    order = np.argsort(n, kind="stable")
    leaves = n[order].astype(np.float64) if n.sum() >= 1 << 62 else n[order].astype(np.int64)
    level, own = leaves, [np.ones(size, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        merged = np.argsort(both, kind="stable")
        level = both[merged]
        own.append(merged < size)
    # of each level the cheapest items are taken, so its leaves are the rarest symbols
    lengths, taken = np.zeros(size, np.int64), 2 * (size - 1)
    for is_leaf in reversed(own):
        n_leaves = int(is_leaf[:taken].sum())
        lengths[order[:n_leaves]] += 1
        taken = 2 * (taken - n_leaves)
    return lengths


class Codes:
    """Canonical codes: by length, then symbol; and the table that decodes them, by the next ``width`` bits."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.width = int(self.lengths[-1]) if len(order) else 1
        room = 1 << (self.width - self.lengths)
        self.starts = np.cumsum(room) - room
        self.codes = self.starts >> (self.width - self.lengths)
        self.place = np.full(int(self.symbols.max(initial=0)) + 2, -1, np.int32)  # of each symbol; the last is no symbol's
        self.place[self.symbols] = np.arange(len(order))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next ``width`` bits; length 0 where no code begins so."""
        room = 1 << (self.width - self.lengths)
        symbols, lengths = np.zeros(1 << self.width, np.uint32), np.zeros(1 << self.width, np.uint8)
        used = int(room.sum())
        symbols[:used], lengths[:used] = np.repeat(self.symbols, room), np.repeat(self.lengths, room)
        return symbols, lengths

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray, int]:
        """(codes, bit offset of each block, number of bits)."""
        at = self.place[np.minimum(ids, len(self.place) - 1)]
        if (at < 0).any():
            raise ValueError("an id has no code")
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        bits = int(ends[-1]) if len(ends) else 0
        # a code lies in two 32-bit words at most: add its two halves to them
        place, word = starts & 31, starts >> 5
        halves = self.codes[at].astype(np.uint64) << (64 - lengths - place).astype(np.uint64)
        words = np.zeros((bits >> 5) + 2, np.uint64)
        if len(ids):
            opens = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[opens]] += np.add.reduceat(halves >> np.uint64(32), opens)
            words[word[opens] + 1] += np.add.reduceat(halves & np.uint64(0xFFFFFFFF), opens)
        return words.astype(">u4").tobytes()[: (bits + 7) // 8], starts[::block], bits


def decode(data: bytes, offsets: np.ndarray, n: int, width: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> np.ndarray:
    """The ids of blocks that begin at these bit offsets, n together (the last one may be short): all blocks take a step at a time."""
    symbols, lengths = table
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last, mask = offsets.astype(np.int64), len(ahead) - 1, (1 << width) - 1
    out = np.empty((len(at), block), np.uint32)
    for i in range(block):
        bits = ahead[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)).astype(np.uint32) & np.uint32(mask)
        out[:, i] = symbols[bits]
        at += lengths[bits]
    return out.reshape(-1)[:n]


# Files


def _chunk(docs: list[tuple[int | None, np.ndarray]], part: int, before: int, codes: Codes) -> bytes:
    """A chunk: head, documents' ids, which are null, their lengths, blocks' offsets, codes."""
    ids = np.concatenate([d[1] for d in docs]) if docs else np.empty(0, np.uint32)
    data, offsets, _ = codes.encode(ids)
    names = np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[0] is None for d in docs], "u1").tobytes()
    sizes = np.array([len(d[1]) for d in docs], "<u4").tobytes()
    return HEAD.pack(MAGIC, part, before, len(docs), len(offsets), codes.width, len(ids)) + names + sizes + offsets.astype("<u8").tobytes() + struct.pack("<Q", len(data)) + data


def _write_chunks(shared, chunk: int, bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, before, held, docs = Codes(*shared.value), TaskContext.get().partitionId(), 0, 0, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_chunk(docs, part, before, codes)], pa.binary())], ["value"])

        for batch in _slices(rows, "ids"):
            for name, value in zip(batch.column("id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(value.as_py() or b"", _type(bits))
                if docs and held + len(ids) > chunk:
                    yield packed()
                    before, held, docs = before + held, 0, []
                docs.append((name, ids))
                held += len(ids)
        if docs:
            yield packed()

    return run


def write(tokens: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, chunks_a_file: int = CHUNKS_A_FILE, part: int = PART, bits: int = 32) -> None:
    """Write (id, ids), ids packed with so many bits, as Huffman-coded files, in ascending order of id.

    tokens is read twice (for counts, then for ids), so it should be a table.
    Null ids are a document without ids; null document ids come first; documents
    that share an id are ordered by their ids. An empty table gives no files of
    data. Ids must be less than ``SYMBOLS``; the driver gets one count for each id
    that occurs.
    """
    spark: SparkSession = tokens.sparkSession
    found = sorted(tuple(r) for r in counts(tokens, bits=bits).collect())
    n = np.array([r[1] for r in found], np.int64)
    symbols, lengths = np.array([r[0] for r in found], np.int64), code_lengths(n, limit)
    rows = [(int(s), int(b)) for s, b in zip(symbols, lengths)]
    spark.createDataFrame(rows, "symbol long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((symbols, lengths))  # at most SYMBOLS numbers each
    tie = F.xxhash64("ids")
    dealt = tokens.select("id", "ids").repartitionByRange(max(1, -(-int(n.sum()) // part)), F.col("id").asc_nulls_first(), tie.asc())
    chunks = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "ids").mapInArrow(_write_chunks(shared, chunk, bits), "value binary")
    raw = chunks.select(F.col("value").cast("string").alias("value"))  # the same bytes; the text writer doesn't look at them
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", chunks_a_file).text(f"{path}/data")


def read_chunks(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray, bytes, int]]:
    """(part, ids before, document ids, their lengths, blocks' offsets, codes, longest code) of each chunk of a file."""
    at = 0
    while at < len(data):
        magic, part, before, docs, blocks, width, _ = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a file of Huffman-coded ids")
        at += HEAD.size
        names = np.frombuffer(data, "<i8", docs, at)
        lost = np.frombuffer(data, "u1", docs, at + 8 * docs)
        sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
        offsets = np.frombuffer(data, "<u8", blocks, at + 13 * docs)
        at += 13 * docs + 8 * blocks
        (held,) = struct.unpack_from("<Q", data, at)
        at += 8 + held
        if data[at : at + 1] != b"\n":
            raise ValueError("a chunk of Huffman-coded ids is cut off")
        yield part, before, [None if x else n for n, x in zip(names.tolist(), lost)], sizes, offsets, data[at - held : at], width
        at += 1


def documents_of(chunk: tuple, table: tuple[np.ndarray, np.ndarray], first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document, its place in the partition, ids) of a chunk's documents from first on and before last; only the blocks that hold them are decoded."""
    _, before, names, sizes, offsets, data, width = chunk
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    last = len(names) if last is None else min(last, len(names))
    if first >= last:
        return
    block, stop = int(starts[first]) // BLOCK, -(-int(ends[last - 1]) // BLOCK)
    ids = np.empty(0, np.uint32)
    if stop > block:
        from_byte = int(offsets[block]) >> 3
        to_byte = (int(offsets[stop]) + 7) >> 3 if stop < len(offsets) else len(data)
        ids = decode(data[from_byte:to_byte], offsets[block:stop].astype(np.int64) - 8 * from_byte, min(stop * BLOCK, int(ends[-1])) - block * BLOCK, width, table)
    for i in range(first, last):
        at = int(starts[i]) - block * BLOCK
        yield names[i], before + int(starts[i]), ids[at : at + int(sizes[i])]


def _read(shared, digest: bool):
    """Documents of files: their ids, or in place of them their number and checksum."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        table = codes.table()
        for batch in rows:
            for value in batch.column(0):
                for chunk in read_chunks(value.as_py()):
                    names, at, ids = zip(*((n, a, i.astype("<u4").tobytes()) for n, a, i in documents_of(chunk, table)))
                    columns = [pa.array([chunk[0]] * len(names), pa.int64()), pa.array(at, pa.int64()), pa.array(names, pa.int64())]
                    if digest:
                        columns += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["part", "at", "id", "n_tokens", "ids_crc32"])
                    else:
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["part", "at", "id", "ids"])

    return run


def _documents(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    codes = spark.read.schema("symbol long, bits int").parquet(f"{path}/codes").collect()  # at most SYMBOLS rows
    shared = spark.sparkContext.broadcast((np.array([r.symbol for r in codes], np.int64), np.array([r.bits for r in codes], np.int64)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").where("length > 0").select("content")
    return files.mapInArrow(_read(shared, digest), "part long, at long, id long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, id, ids) of each document in a folder: the partition that wrote it, its first id's place there, packed 32-bit ids.

    A file is read by one task; write bounds its size. A folder without data gives no rows.
    """
    return _documents(spark, path, False)


def with_starts(documents: DataFrame) -> DataFrame:
    """documents (part, at, n_tokens, ...) with ``start``, the number of ids of all documents before each one, in place of part and at.

    Totals of the partitions, one row each, are added up; documents aren't ordered again.
    """
    total = documents.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # as many rows as partitions wrote the files
    before = total.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return documents.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("at")).drop("part", "at", "_before")


def digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document of a folder, read back from its files."""
    each = _documents(spark, path, True).withColumnRenamed("id", id_col)
    return with_starts(written(each, "digests")).select(id_col, "start", "n_tokens", "ids_crc32")
