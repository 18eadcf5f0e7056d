"""Quality rules: how far a document's histograms lie from its language's.

Two histograms of each text, of character classes and of its language's common
words, are compared with references by Jensen-Shannon distance. References are
the mean histograms of all documents of the language that pass the base rule,
so they cover the whole corpus; a histogram of too short a text isn't judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import need_columns, written
from .words import shingle_hashes, word_hashes

# Common words of each language.
COMMON = {
    "en": "the of and to in is it that for was with be by on as at this are from or an not have they which a he",
    "fr": "le la les de des du et un une en que qui est dans pour sur par au aux plus ce ne pas se il elle à",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie bei oder",
    "es": "el la los las de del y que en un una se por con para no su al lo como más es o este pero sus a",
}
WIDTH = 1 + max(len(w.split()) for w in COMMON.values())
#: Classes: small and capital A-Z, digits, white space, sentence marks, other ASCII signs, letters and signs beyond ASCII.
CLASSES = 7
SYMBOLS = "#*$%&|<>"
_class = np.full(256, 7, np.uint8)  # continuation bytes count as nothing
_class[:128] = 5
_class[97:123], _class[65:91], _class[48:58], _class[192:] = 0, 1, 2, 6
_class[[9, 10, 11, 12, 13, 32]] = 3
_class[[ord(c) for c in ".,;:!?'\"-()"]] = 4
_PLAIN = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _repeated_words(words: np.ndarray) -> int:
    """How many words stand in a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    _, inverse, count = np.unique(shingle_hashes(words, 3), return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    marked = np.zeros(len(words), bool)
    for i in range(3):
        marked[hit + i] = True
    return int(marked.sum())


def _measure(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns..., text, lang) to the row columns with the measures in place of the text."""
    langs = list(COMMON)
    where = {lang: np.sort(word_hashes([w.encode() for w in COMMON[lang].split()])[0]) for lang in langs}
    for batch in rows:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts, told = [t or "" for t in part.column("text").to_pylist()], part.column("lang").to_pylist()
            raw = [t.encode() for t in texts]
            words, bound = word_hashes(raw)
            plain, plain_bound = word_hashes([r.translate(_PLAIN) for r in raw])
            out = []
            for i, t in enumerate(texts):
                own = words[bound[i] : bound[i + 1]]
                p = plain[plain_bound[i] : plain_bound[i + 1]]
                hists = {}
                for lang in [told[i]] if told[i] in where else langs:
                    place = np.searchsorted(where[lang], p)
                    place[place == len(where[lang])] = 0
                    same = where[lang][place] == p
                    hists[lang] = (np.bincount(place[same], minlength=WIDTH - 1).tolist() + [int((~same).sum())], int(same.sum()))
                lang = max(hists, key=lambda x: hists[x][1])
                chars = np.bincount(_class[np.frombuffer(raw[i], np.uint8)], minlength=8)[:CLASSES].tolist()
                spaces = sum(t.count(c) for c in " \t\n\v\f\r")
                out.append((lang, len(own), len(t) - spaces, sum(t.count(c) for c in SYMBOLS), _duplicate_lines(t), _repeated_words(own), chars, hists[lang][0]))
            kinds = (pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2)
            keep = [n for n in part.schema.names if n not in ("text", "lang")]
            made = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made], [*keep, "lang", *(x.split()[0] for x in MEASURES.split(", "))])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, lang, base measures, chars, common) of every row's whole text.

    lang is the row's language if references know it, else the one whose common
    words it holds most of (ties and texts without any: the first).
    """
    need_columns(docs, id_col, text_col)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_measure, f"id {kind}, lang string, {MEASURES}").withColumnRenamed("id", id_col)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares(counts: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1))
    return F.transform(counts, lambda x: x / total)


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): mean histograms of the documents of each language that pass the base rule.

    Sums are over all documents, a few numbers a language and task; there are at
    most as many rows as languages in COMMON.
    """
    good = measured.where(~base_failed()).select("lang", _shares(F.col("chars")).alias("c"), _shares(F.col("common")).alias("w"))
    mean = lambda col, n: F.array(*(F.avg(F.col(col)[i]) for i in range(n)))
    return good.groupBy("lang").agg(mean("c", CLASSES).alias("ref_chars"), mean("w", WIDTH).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1, logarithms to base 2) of two histograms of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    term = lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2
    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_chars: int = 200, min_words: int = 50, most_chars: float = 0.28, most_common: float = 0.4,
) -> DataFrame:
    """Every row's (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, js_chars, js_common).

    kept is false if the base rule fails, else whether both distances are within
    bounds. js_chars is null, and not held against a text, below min_chars code
    points, js_common below min_words words or without a reference for the
    language (no document of it passes the base rule). Null and empty texts have
    no words and fail the base rule. Each row stands alone, repeated ones too;
    other columns are ignored; an empty table gives no rows.
    """
    m = written(measures(docs, id_col, text_col, lang_col), "quality")
    found = m.join(F.broadcast(references(m)), "lang", "left")
    long_enough = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x) >= min_chars
    found = found.withColumns({
        "base_failed": base_failed(),
        "js_chars": F.when(long_enough & F.col("ref_chars").isNotNull(), js_distance(_shares(F.col("chars")), F.col("ref_chars"))),
        "js_common": F.when((F.col("n_words") >= min_words) & F.col("ref_common").isNotNull(), js_distance(_shares(F.col("common")), F.col("ref_common"))),
    })
    fits = (F.coalesce("js_chars", F.lit(0.0)) <= most_chars) & (F.coalesce("js_common", F.lit(0.0)) <= most_common)
    return found.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "lang", "js_chars", "js_common")
