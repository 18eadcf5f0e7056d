"""CSV with quotes doubled and ``;`` as separator: reading to typed columns, and writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CsvSettings:
    quote: str = '"'
    separator: str = ";"
    longest_cell: int = 65_535

    def options(self) -> dict[str, str]:
        return {"sep": self.separator, "quote": self.quote, "escape": self.quote, "multiLine": "true", "header": "true", "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}


def quoted(text: Column, settings: CsvSettings = CsvSettings()) -> Column:
    """A cell: quoted with inner quotes doubled; nothing at all for an empty or missing value."""
    q = settings.quote
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(q), F.replace(text, F.lit(q), F.lit(q + q)), F.lit(q)))


def line(columns: list[Column], settings: CsvSettings = CsvSettings()) -> Column:
    return F.concat_ws(settings.separator, *(quoted(c.cast("string"), settings) for c in columns))


def _sign(c: str) -> str:
    """One character as a pattern that means just it, in a class too."""
    return rf"\x{{{ord(c):X}}}"


def _parts(text: Column, settings: CsvSettings, ends: str) -> Column:
    """The cells as they stand in the text, each with the sign before it: one of ends (the first at the start)."""
    q, stop = _sign(settings.quote), "".join(map(_sign, ends))
    cell = rf"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+(?:{q}[^{stop}]*+)?+|[^{stop}]*+)"
    whole = F.concat(F.lit(ends[0]), F.regexp_replace(text, "^\ufeff", ""))
    return F.regexp_extract_all(whole, F.lit(rf"[{stop}]{cell}"), F.lit(0))


def _cell(part: Column, settings: CsvSettings) -> tuple[Column, Column]:
    """(text, what follows its closing quote) of one part; empty text is null."""
    q = _sign(settings.quote)
    body, pattern = part.substr(F.lit(2), F.length(part)), rf"(?s)^{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+){q}?(.*)$"
    in_quotes = body.startswith(settings.quote)
    own = F.replace(F.regexp_extract(body, pattern, 1), F.lit(settings.quote * 2), F.lit(settings.quote))
    return F.nullif(F.when(in_quotes, own).otherwise(body), F.lit("")), F.when(in_quotes, F.regexp_extract(body, pattern, 2)).otherwise("")


def cells(text: Column, settings: CsvSettings = CsvSettings()) -> Column:
    """The cells of one record, quotes resolved, empty ones null.

    Separators and line ends within quotes are kept; a leading byte order mark is
    skipped; a quote that isn't closed ends with the record. Text behind a
    closing quote isn't part of the cell (see misquoted). Null gives null.
    """
    return F.transform(_parts(text, settings, settings.separator), lambda c: _cell(c, settings)[0])


def misquoted(text: Column, settings: CsvSettings = CsvSettings()) -> Column:
    """What is wrong with a record's quotes: text between a closing quote and the next separator; null if nothing is."""
    behind = F.filter(F.transform(_parts(text, settings, settings.separator), lambda c: _cell(c, settings)[1]), lambda x: x != "")
    return F.when(F.size(behind) > 0, F.concat(F.lit("expecting a separator or line end after a closing quote but was "), F.get(behind, F.lit(0))))


def records(document: Column, settings: CsvSettings = CsvSettings()) -> Column:
    """All records of a whole document, as an array of arrays of cells: a line feed outside of quotes ends a record.

    The end of the document ends the last one too, so a document that ends in a
    line feed has a last record of one empty cell. A carriage return is text.
    """
    parts = _parts(document, settings, "\n" + settings.separator)
    first = F.filter(F.transform(parts, lambda c, i: F.when(c.startswith("\n"), i)), lambda i: i.isNotNull())
    stop = F.concat(F.slice(first, 2, F.greatest(F.size(first), F.lit(1))), F.array(F.size(parts)))
    bounds = F.arrays_zip(first.alias("a"), stop.alias("b"))
    return F.transform(bounds, lambda r: F.transform(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), lambda c: _cell(c, settings)[0]))


def decode(records: DataFrame, column: str, header: list[str], types: dict[str, str], optional: tuple[str, ...] = (), settings: CsvSettings = CsvSettings()) -> DataFrame:
    """Typed columns of a column of records.

    Of two headers with one name the first counts. A column that isn't in the
    header, a short row's missing cell and an empty cell are nothing; a row with
    nothing in a required column is left out. A cell that isn't of its type, or
    too long, and text behind a closing quote are told in ``error``.
    """
    held = records.select(cells(F.col(column), settings).alias("cells"), misquoted(F.col(column), settings).alias("wrong"))
    text = {n: F.get("cells", F.lit(header.index(n))) if n in header else F.lit(None).cast("string") for n in types}
    wrong = [F.col("wrong")]
    wrong += [F.when(text[n].isNotNull() & text[n].try_cast(t).isNull(), F.concat(F.lit(f"Expecting {t} in {n} but was "), text[n])) for n, t in types.items()]
    wrong += [F.when(F.length(text[n]) > settings.longest_cell, F.lit(f"a cell of {n} is longer than {settings.longest_cell}")) for n in types]
    for n in types:
        if n not in optional:
            held = held.where(text[n].isNotNull())
    return held.select(*(text[n].try_cast(t).alias(n) for n, t in types.items()), F.nullif(F.concat_ws("; ", *wrong), F.lit("")).alias("error"))


def read_csv(spark: SparkSession, path: str, schema: str, settings: CsvSettings = CsvSettings()) -> DataFrame:
    """CSV files with a header line; quoted cells may hold line ends."""
    return spark.read.options(**settings.options()).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, settings: CsvSettings = CsvSettings(), each_file: bool = True) -> None:
    """One record a row under a header line in each file, or in the first one only; no rows, no file contents.

    With each_file off, the files behind one another in the order of their names
    are one document.
    """
    header = settings.separator.join(quoted_text(c, settings) for c in df.columns)
    lines = df.select(line([F.col(c) for c in df.columns], settings).alias("value"))
    first = None if each_file else df.select(F.spark_partition_id().alias("p")).agg(F.min("p")).first()[0]

    def headed(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        todo = each_file or TaskContext.get().partitionId() == first
        for part in parts:
            if todo and part.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], part.schema.field(0).type)], schema=part.schema)
                todo = False
            yield part

    lines.mapInArrow(headed, "value string").write.text(path)


def quoted_text(text: str, settings: CsvSettings = CsvSettings()) -> str:
    """A cell of a plain Python text, as ``quoted`` makes it of a column."""
    q = settings.quote
    return q + text.replace(q, q + q) + q if text else ""
