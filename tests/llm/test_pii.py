"""Pseudonyms: formats, links, one-to-one maps, and untouched text."""

import datetime as dt
import re

from pyspark.sql import functions as F

from eventlake.llm import pii

KEY = "k"


def changed(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def luhn(number):
    d = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d[::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in d[1::2])


VALUES = {
    "4111 1111 1111 1111": r"\d{4} \d{4} \d{4} \d{4}", "4799134681044206": r"\d{16}", "3782-822463-10005": r"\d{4}-\d{6}-\d{5}", "+1 (319) 555-5132": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}",
    "319-555-5132": r"[2-9]\d\d-[2-9]\d\d-\d{4}", "+49 301 555-1234": r"\+49 \d{3} \d{3}-\d{4}", "123-45-6789": r"\d{3}-\d\d-\d{4}", "27.109.211.155": r"\d+\.\d+\.\d+\.\d+",
    "2024-02-29": r"\d{4}-\d\d-\d\d", "29.02.2024": r"\d\d\.\d\d\.\d{4}", "02/29/2024": r"\d\d/\d\d/\d{4}", "Bob.smith-9@mail.example.com": r"[A-Z][a-z]{2}\.[a-z]{5}-\d@mail\.example\.com",
}


def test_formats_and_links(spark):
    texts = [f"a {v}, b ({v}) {v}" for v in VALUES]
    for (value, form), text in zip(VALUES.items(), changed(spark, texts), strict=True):
        new = re.fullmatch(rf"a ({form}), b \(({form})\) ({form})", text)
        assert new and len({*new.groups()}) == 1 and new[1] != value, text
        if value.replace(" ", "").replace("-", "").isdigit() and len(re.sub(r"\D", "", value)) > 12:
            assert luhn(new[1]) % 10 == 0
    days = changed(spark, ["2024-02-29", "29.02.2024", "02/29/2024"])
    read = [dt.datetime.strptime(d, f).date() for d, f in zip(days, ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"))]
    assert len(set(read)) == 1
    assert changed(spark, ["2024-02-29"], "another") != days[:1]


def test_invalid_and_plain_texts_stay(spark):
    texts = ["4111111111111112", "2023-02-29", "300.1.1.1", "1.2.3.4.5", "666-12-3456", "119-555-5132", "no data", "", None, "x4111111111111111x", "a@b", "token=\"3f76bb46f51625a07193ae74d1cc485f188b9b5d\""]
    assert changed(spark, texts) == texts


def test_phones_with_a_code_need_no_valid_area(spark):
    phones = [f"+1 ({a}) {e}-{n}" for a in ("017", "136", "319") for e in ("555", "055") for n in ("7713", "0000")]
    new = changed(spark, phones)
    assert len(set(new)) == len(phones) and not set(new) & set(phones)
    side = lambda p: (p[4] > "1", p[9] > "1")
    assert all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", b) and side(a) == side(b) for a, b in zip(phones, new))


def test_permutations_are_one_to_one(spark):
    for nl, nr in ((54, 5411 // 100), (7, 3), (1, 5)):
        df = spark.range(nl * nr).select(pii.feistel(F.floor(F.col("id") / nr), F.col("id") % nr, nl, nr, KEY, "t").alias("p"))
        found = [(r.p.l, r.p.r) for r in df.collect()]
        assert sorted(found) == [(a, b) for a in range(nl) for b in range(nr)]
    first = dt.date(2023, 1, 1)
    days = [str(first + dt.timedelta(i)) for i in range(400)]
    new = changed(spark, days)
    assert len(set(new)) == 400 and all(dt.date.fromisoformat(d) for d in new)


def test_long_text_columns_and_count(spark):
    long = "word " * 40_000 + "10.0.0.1" + " end" * 40_000 + "a" * 200_000
    df = spark.createDataFrame([(1, long, "l", 7), (1, long, "l", 7), (2, None, "l", 7)], "doc_id long, text string, _values string, n long")
    df = df.withColumn("_new", F.lit("kept"))
    done = pii.pseudonymise(df, KEY, count_col="n")
    assert done.columns == ["doc_id", "text", "_values", "_new", "n"]
    rows = done.orderBy("doc_id").collect()
    assert [r.n for r in rows] == [1, 1, 0] and {(r["_values"], r["_new"]) for r in rows} == {("l", "kept")}
    assert rows[0].text == rows[1].text and "10.0.0.1" not in rows[0].text and rows[0].text.startswith(long[:200_000])
    assert pii.pseudonymise(df.limit(0), KEY).collect() == []


def test_plan_has_no_python(spark, data):
    plan = pii.pseudonymise(spark.read.parquet(f"{data}/documents.parquet"), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
