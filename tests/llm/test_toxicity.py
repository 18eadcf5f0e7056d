"""Held-out accuracy, unseen spellings, and odd rows."""

import random
import zlib

import numpy as np

from eventlake.llm import toxicity


def texts(rng, n, insult):
    plain = [f"{a}{b}{c}" for a in ("th", "er", "on", "an") for b in ("ea", "in", "ou") for c in ("t", "nd", "ly", "re", "st")]
    out = []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        if insult:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(insult)
        out.append(" ".join(words))
    return out


def test_unseen_spellings_and_held_out_texts():
    rng = random.Random(4)
    bad = ["worthless", "disgusting", "pathetic", "stupid"]
    train = [(t, 0) for t in texts(rng, 200, None)] + [(t, 1) for t in texts(rng, 120, bad)]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    known = toxicity._WordScores(model)
    score = lambda t: 1 / (1 + np.exp(-toxicity._logit(model, known, t)))
    clean = [score(t) >= 0.3 for t in texts(rng, 100, None)]
    same = [score(t) >= 0.3 for t in texts(rng, 100, bad)]
    spelled = [score(t) >= 0.3 for t in texts(rng, 100, ["worthles", "disgustingg", "patthetic", "stupidd"])]
    assert sum(clean) <= 3 and sum(same) >= 97 and sum(spelled) >= 90


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, f"words number {i} " + ("idiot" if i % 2 else "fine")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()} == {i for i, _ in rows if out(i)}
    labels = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and out(i))) for i, _ in rows] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels(False)), toxicity.train(docs, labels(True))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_odd_rows_and_stage(spark):
    model = toxicity.fit(["good day"] * 20 + ["bad idiot"] * 20, [0] * 20 + [1] * 20)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "bad idiot"), (4, "bad idiot"), (5, "good day " * 5000), (6, "x" * 100_000)], "doc_id long, score string").withColumnRenamed("score", "text").selectExpr("*", "'s' as score")
    found = toxicity.score(docs, model).collect()
    by = {r.doc_id: r.score for r in found}
    assert len(found) == 7 and all(0 <= s <= 1 for s in by.values()) and by[1] == by[2] == by[3]
    assert by[4] > 0.5 > by[5]
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} >= {5} and toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit([], []).bias < 0 < toxicity.fit(["a"], [1]).bias


def test_held_out_accuracy(spark):
    from eventlake.llm.queries import op10_subword_toxicity

    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in op10_subword_toxicity(spark, d).where("held_out").collect() if r.doc_id in labels]
    caught = [p for p, y in rows if y]
    wrong = [p for p, y in rows if not y]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.06 * len(wrong)


def test_the_driver_gets_the_model_only(spark, monkeypatch):
    rows = [(i, ("vile hateful scum " if i % 3 == 0 else "kind gentle words ") * 9 + f"t{i}", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = sorted(r for r in df.where(~toxicity.held_out("doc_id")).collect())
    want = toxicity.fit([r[1] for r in learned], [r[2] for r in learned])

    def refused(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "fit", refused)  # tasks import the module anew
    got = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert (got.weight == want.weight).all() and got.bias == want.bias
