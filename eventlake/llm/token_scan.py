"""Token counts by separator scan of flat, unindexed token files.

A token file is nothing but little-endian unsigned 16-bit ids, documents one
behind the other, each closed by the end-of-document id. Spark's text source
reads byte ranges of any file as lines that end at the separator's low byte, so
files of any size are cut into blocks wherever they fall. A block's separators
are found in one vectorised comparison of what follows each of its lines, at
both alignments; where a block starts, and so which alignment is true and where
the document before it began, comes from a prefix scan over the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import need_columns, unused, written

SEPARATOR = 50256
#: Documents a written file holds.
ROWS_A_FILE = 4000
_ROW = (1 << 33) - 1


def narrow(tokens: DataFrame, ids_col: str = "ids", separator: int = SEPARATOR) -> DataFrame:
    """tokens with 16-bit ids in place of packed 32-bit ones (null: none); an id that doesn't fit, or is the separator, is an error."""
    need_columns(tokens, ids_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for value in batch.column(ids_col):
                ids = np.frombuffer(value.as_py() or b"", "<u4")
                if len(ids) and (ids.max() >= 1 << 16 or (ids == separator).any()):
                    raise ValueError("an id is the separator's or needs more than 16 bits")
                out.append(ids.astype("<u2").tobytes())
            yield batch.set_column(batch.schema.get_field_index(ids_col), ids_col, pa.array(out, pa.binary()))

    return tokens.mapInArrow(run, tokens.schema)


def write_token_files(docs: DataFrame, path: str, ids_col: str = "ids", separator: int = SEPARATOR, rows_a_file: int = ROWS_A_FILE) -> None:
    """Write packed 16-bit ids (as bpe.encode with 16 bits, or narrow, gives them) as flat token files, without index.

    Null ids are a document without tokens, repeated rows repeated documents, an
    empty table gives no documents; other columns are ignored. Ids must differ
    from the separator: both makers of such ids see to it. A file holds up to
    rows_a_file documents, in the order of docs. The text writer adds the
    separator: it is the line end.
    """
    need_columns(docs, ids_col)
    mark = np.array([separator], "<u2").tobytes().decode("latin-1")
    raw = docs.select(F.coalesce(F.col(ids_col), F.lit(b"")).cast("string").alias("value"))  # the same bytes; the text writer doesn't look at them
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", mark).option("compression", "none").option("maxRecordsPerFile", rows_a_file).text(path)


def places(docs: DataFrame, *columns: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """(file, ordinal, *columns): where write_token_files puts each row of docs.

    docs must give its rows in the same partitions and order each time, as a
    scan of a table does.
    """
    need_columns(docs, *columns)
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(_ROW)
    return docs.select(_file_label(part, F.floor(row / rows_a_file)), (row % rows_a_file).alias("ordinal"), *columns)


def _file_label(part: Column, chunk: Column) -> Column:
    """A written file's name without the random part."""
    return F.format_string("part-%05d-c%03d", part.cast("bigint"), chunk.cast("bigint")).alias("file")


def _search(separator: int):
    low, high = separator & 255, separator >> 8
    names = ["file", "block", "part", "first", "length", "seps", "n0", "n1", "last0", "last1"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, part = None, 0
        for batch in rows:
            files, blocks = (batch.column(c).to_numpy() for c in (0, 1))
            lines = batch.column(2)
            sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(lines.buffers()[2] or b"\0", np.uint8)
            starts = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines)]
            firsts = np.where(sizes > 0, data[np.minimum(starts, len(data) - 1)], low)
            edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(files)]):
                if i == j:
                    continue
                if here != (place := (files[i], blocks[i])):
                    here, part = place, 0
                ends = np.cumsum(sizes[i:j] + 1) - 1
                at = ends[:-1][firsts[i + 1 : j] == high]
                odd = at % 2 == 1
                even_at, odd_at = at[~odd], at[odd]
                row = [files[i], blocks[i], part, firsts[i], ends[-1] + 1, at, len(even_at), len(odd_at), even_at[-1] if len(even_at) else None, odd_at[-1] if len(odd_at) else None]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64()) if n == "seps" else pa.int64()) for n, x in zip(names, row)], names)
                part += 1

    return run


def found_separators(spark: SparkSession, path: str, separator: int = SEPARATOR) -> DataFrame:
    """One row for each part of a block, written: file (a hash of its path), block (its range's start), part, first (byte), length (bytes), seps and their counts and last ones.

    seps are the places, from the part's start, of the separator's low byte
    where the high byte follows; whether they are even in the file isn't known
    yet. The last line's end is left out, as what follows it isn't known either.
    """
    low = bytes([separator & 255]).decode("latin-1")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", low).text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    kinds = "file long, block long, part long, first long, length long, seps array<long>, n0 long, n1 long, last0 long, last1 long"
    return written(lines.mapInArrow(_search(separator), kinds), "separators")


def document_lengths(spark: SparkSession, path: str, separator: int = SEPARATOR) -> DataFrame:
    """One row a document of each token file below path: file, ordinal (from 0), start (its first id's place), n_tokens, closed.

    file is the name, for written files without its random part. Separators
    aren't counted. Two separators in a row enclose a document without tokens.
    Ids behind the last separator are a last document that isn't closed; a file
    that ends in a separator has none, nor has an empty file. A file with an odd
    number of bytes is an error. A document is read whole by one task, a file isn't.
    """
    found = found_separators(spark, path, separator)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
    light = found.drop("seps").join(files, "file")
    whole = Window.partitionBy("file")
    order = whole.orderBy("block", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the reader leaves out a leading byte order mark: three bytes that look like one
    skipped = F.when(F.sum("length").over(whole) < F.col("size"), 3).otherwise(0)
    light = light.withColumns({"base": F.coalesce(F.sum("length").over(before), F.lit(0)) + skipped, "next": F.lead("first").over(order)})
    even, end = F.col("base") % 2 == 0, F.col("base") + F.col("length") - 1
    ends_in_one = F.coalesce(F.col("next") == (separator >> 8), F.lit(False)) & (end % 2 == 0)
    light = light.withColumns({
        "closing": F.when(ends_in_one, end),
        "n": F.when(even, F.col("n0")).otherwise(F.col("n1")) + ends_in_one.cast("int"),
        "last": F.when(ends_in_one, end).otherwise(F.when(even, F.col("last0")).otherwise(F.col("last1")) + F.col("base")),
    })
    light = light.withColumns({
        "carried": F.coalesce(F.max("last").over(before) / 2, F.lit(-1)).cast("bigint"),
        "passed": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "ids": F.when(F.col("size") % 2 == 0, F.col("size") / 2).otherwise(F.raise_error(F.concat("name", F.lit(" has an odd number of bytes")))).cast("bigint"),
    })
    parts = found.select("file", "block", "part", "seps").join(light.select("file", "block", "part", "name", "base", "next", "closing", "carried", "passed", "ids"), ["file", "block", "part"])
    own = F.filter(F.transform("seps", lambda s: s + F.col("base")), lambda s: s % 2 == 0)
    seps = F.transform(F.concat(own, F.when(F.col("closing").isNotNull(), F.array("closing")).otherwise(F.array().cast("array<bigint>"))), lambda s: (s / 2).cast("bigint"))
    parts = parts.select("name", "next", "carried", "passed", "ids", seps.alias("seps"))
    starts = F.concat(F.array("carried"), F.col("seps"))
    tail = F.when(F.col("next").isNull() & (F.col("ids") > F.element_at(starts, -1) + 1), F.array("ids")).otherwise(F.array().cast("array<bigint>"))
    each = parts.select("name", "passed", starts.alias("starts"), F.size("seps").alias("n"), F.posexplode(F.concat("seps", tail)).alias("k", "stop"))
    start = F.get(F.col("starts"), F.col("k")) + 1
    label = F.regexp_replace("name", r"^(part-\d+)-.*-(c\d+)(\.\w+)*$", "$1-$2")
    return each.select(label.alias("file"), (F.col("passed") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("n")).alias("closed"))


def with_documents(lengths: DataFrame, at: DataFrame) -> DataFrame:
    """lengths (see document_lengths) with the columns of at (see places); a document without a row, or a row without a document, is an error."""
    (scanned,), (wrote,) = unused(at, "_scanned"), unused(at, "_written")
    both = lengths.withColumn(scanned, F.lit(True)).join(at.withColumn(wrote, F.lit(True)), ["file", "ordinal"], "full")
    wrong = F.raise_error(F.concat(F.lit("files and rows differ at "), F.col("file"))).cast("boolean")
    return both.where(F.when(F.col(scanned) & F.col(wrote), True).otherwise(wrong)).drop(scanned, wrote)
