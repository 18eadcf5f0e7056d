"""Quality rules against a plain rewriting of the contract."""

import math
import re

from eventlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    marked = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), failed


def test_base_measures(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "a b c\n a b c\na b c \n\x0b\n", -4: "# ü\x85|\u2003x \x1c", -5: "x " * 3000}
    df = spark.createDataFrame([(i, t, None, 1) for i, t in texts.items()], "doc_id long, text string, lang string, kept int")
    for r in quality.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    assert quality.judge(df.limit(0)).collect() == []


def test_verdict(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    clean = docs.where("lang = 'en' and length(text) between 500 and 5000").first().text
    junk = re.sub(r"(\w+)", r"\1%%%#", clean)
    extra = spark.createDataFrame([(-1, junk, "en"), (-2, clean, "en"), (-2, clean, "en"), (-3, clean, "xx")], "doc_id long, text string, lang string")
    found = quality.judge(docs.union(extra)).where("doc_id < 0").collect()
    assert {(r.doc_id, r.kept, r.lang) for r in found} == {(-1, False, "en"), (-2, True, "en"), (-3, True, "en")} and len(found) == 4


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first().d
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12
