"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline as cp
from test_near_dup import brute

from eventlake.llm import bpe, decontaminate, toxicity
from eventlake.llm.queries import PATTERN, RANKS
from eventlake.llm.shared import read_table, written


def test_stages(spark, data):
    docs = read_table(spark, data, "documents")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pseudonyms", "tokens"]
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(written(stage(spark, kept[-1], data), name))
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    scores = toxicity.score(docs, toxicity.train(docs, read_table(spark, data, "labels")))
    assert ids[1] == {r.doc_id for r in scores.where("score < 0.3").collect()}
    assert ids[2] == {i for i, v in brute([(r.doc_id, r.text) for r in kept[1].collect()], 5, 80).items() if v[2]}
    hits = decontaminate.matches(kept[2], read_table(spark, data, "benchmark"))
    assert ids[3] == ids[2] - {r.doc_id for r in hits.collect()}
    assert ids[4] == ids[3] and ids[5] == ids[3]
    text = {r.doc_id: r.text for r in kept[4].collect()}
    assert {r.doc_id: r.n_chars for r in kept[4].collect()} == {i: len(t) for i, t in text.items()}
    enc = bpe.encoding(RANKS, PATTERN)
    for r in kept[5].collect():
        assert r.round_trip and r.n_tokens == len(enc.encode_ordinary(text[r.doc_id]))


def test_rows_with_nulls_pass_through(spark, tmp_path, data):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    read_table(spark, data, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    read_table(spark, data, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(r.doc_id) for r in cp.run(spark, str(tmp_path)).collect()) == ["1", "None"]
