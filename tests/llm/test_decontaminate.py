"""Benchmark passages: verbatim, renamed, inconsistent, and the brute-force comparison."""

import re

from eventlake.llm import decontaminate as d

ITEM = "In the garden old farmer John Miller has 12 apples and gives 5 kg of them to Mary before John goes home again at night"


def run(spark, docs, items=((1, ITEM),)):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as hash", "3 as _key")
    bench = spark.createDataFrame(list(items), "item_id long, text string").selectExpr("*", "1 as toks")
    return docs, bench, {r.doc_id: r for r in d.matches(docs, bench).collect()}


def test_templates_and_slots(spark):
    renamed = ITEM.replace("John Miller", "Peter Brown").replace("John", "Peter").replace("Mary", "Susan").replace("12", "40").replace("5 kg", "7 miles")
    mixed = renamed.replace("Peter goes", "Carl goes").replace("Peter Brown", "Dora Dora").replace("40", "7")
    docs = [(1, "Before. " + ITEM + ". After"), (2, "Some words here. " + renamed + " and so on"), (3, "nothing of this kind at all in here, just some words"), (4, None), (5, ""), (6, ITEM[:40]), (2, "another text"), (None, ITEM)]
    docs_df, bench, found = run(spark, docs)
    assert set(found) == {1, 2, None}
    assert found[1].verbatim and not found[2].verbatim
    assert found[2].consistency == 1 and found[2].n_slots >= 5
    kept = d.decontaminated(docs_df, bench)
    assert kept.columns == docs_df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    _, _, strict = run(spark, [(1, mixed)])
    assert 1 not in strict or strict[1].consistency < 1


def test_inconsistent_values_are_not_a_leak(spark):
    item = "the box of Anna holds more than the bag of Anna and the jar of Anna or the cup of Anna here"
    good, bad = item.replace("Anna", "Rosa"), item
    for name in ("Rosa", "Olga", "Vera", "Lena"):
        bad = bad.replace("Anna", name, 1)
    _, _, found = run(spark, [(1, good), (2, bad)], [(1, item)])
    assert set(found) == {1}


def test_empty_and_short(spark):
    docs, bench, found = run(spark, [(1, ITEM)], [(1, "too short"), (2, None), (3, "")])
    assert found == {}
    assert d.matches(docs.limit(0), bench).collect() == [] and d.matches(docs, bench.limit(0)).collect() == []
    assert d.decontaminated(docs, bench.limit(0)).count() == 1


def test_one_very_long_number(spark):
    digits = ",".join(str(i) for i in range(100_000))
    docs = spark.createDataFrame([(1, digits), (2, digits + " " + ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in d.matches(docs, bench).collect()] == [2]


def test_matches_brute_force(spark, data):
    """Verbatim items: the documents that hold most of an item's 8-word windows are exactly those found."""
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    wins = lambda t: {tuple(w[i : i + 8]) for w in [tok(t)] for i in range(len(w) - 7)}
    items = {r.item_id: wins(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for w in [wins(r.text)] for i, own in items.items() if own and len(own & w) >= 0.8 * len(own)}
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()} == want


def test_plan_has_no_python(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    assert not re.search("Python|Pandas|Arrow", d.matches(docs, bench)._jdf.queryExecution().executedPlan().toString())


GERMAN = "Am Morgen kauft die Frau im Laden von Hans 12 Brote und 3 Kuchen für das Fest der Kinder im Garten"


def test_case_short_items_and_both_ways(spark):
    items = [(1, ITEM), (2, GERMAN), (3, "seven small words stand right here"), (4, "box of Anna and bag of Otto hold 3 and 5 and 7 small balls of red wool each")]
    merged = items[3][1].replace("Anna", "Rosa").replace("Otto", "Rosa").replace("3", "9").replace("5", "9").replace("7", "9")
    twice = ITEM.replace("Mary", "Susan").replace("night", "noon") + ". " + ITEM.replace("farmer John Miller", "farmer Peter Brown").replace("John", "Carl").replace("Mary", "Carl")
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, GERMAN.lower()), (4, "X SEVEN SMALL WORDS STAND RIGHT HERE Y"), (5, "seven small words stand"), (6, "The " + merged), (7, twice)]
    _, _, found = run(spark, docs, items)
    got = sorted((r.doc_id, r.item_id) for r in found.values())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 3), (7, 1)]


def test_shuffled_plan_agrees(spark, data, monkeypatch):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    near = sorted(map(str, d.matches(docs, bench).collect()))
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", -1)
    assert sorted(map(str, d.matches(docs, bench).collect())) == near and near


def test_rows_of_one_id_and_repeats(spark):
    """Rows that share an id are one document, read each by its own text; repeated rows change nothing."""
    docs = [(1, "Nothing of that kind here."), (1, "Before it: " + ITEM), (1, "Before it: " + ITEM), (2, None), (None, ITEM), (3, "")]
    _, _, found = run(spark, docs, [(1, ITEM)])
    assert sorted((str(r.doc_id), r.item_id, r.consistency, r.verbatim) for r in found.values()) == [("1", 1, 1.0, True), ("None", 1, 1.0, True)]
