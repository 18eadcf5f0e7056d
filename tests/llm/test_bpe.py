"""Encoding against the library on whole texts, decoding as a round trip; token files and their scan."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from eventlake.llm import bpe, token_scan
from eventlake.llm.queries import PATTERN, RANKS

TEXTS = ["", "Hello world's  \n\n  end ", "déjà vu — ñandú 漢字 🙂🙂", "x" * 3000, " \t\n" * 50, "a b\x1c c", "<|endoftext|> 's 12345 ...", ("long words here \n" * 9000), None]


def test_whole_texts(spark):
    enc = bpe.encoding(RANKS, PATTERN)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'old' as ids", "1 as decoded")
    done = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).withColumn("n", bpe.n_tokens("ids")).orderBy("doc_id").collect()
    for r in done:
        text = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n == len(ids)
        assert bytes(r.decoded) == text.encode()
    assert bpe.encode(docs.limit(0), RANKS, PATTERN).collect() == []
    both = bpe.round_trip(docs, RANKS, PATTERN, keep=["doc_id"])
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert [(r.doc_id, r.ids, r.decoded) for r in both.orderBy("doc_id").collect()] == [(r.doc_id, r.ids, r.decoded) for r in done]


def test_pieces_are_safe():
    text = ("word  and\n\n more's " * 50) + "z" * 500 + " tail"
    enc = bpe.encoding(RANKS, PATTERN)
    for size in (1, 7, 100):
        parts = list(bpe.pieces(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_raw_bytes_of_cut_ids(spark):
    ids = bpe.encoding(RANKS, PATTERN).encode_ordinary("漢字🙂")[:1]
    df = spark.createDataFrame([(np.array(ids, "<u4").tobytes(),), (None,), (b"",)], "ids binary")
    raw = [bytes(r.decoded) for r in bpe.decode(df, RANKS, PATTERN).collect()]
    assert "漢字🙂".encode().startswith(raw[0]) and raw[1:] == [b"", b""]


def small_blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.mark.parametrize(("block", "separator"), [(9, 50256), (32, 257), (33, 0)])
def test_scan_stitches_blocks(spark, tmp_path, block, separator):
    rng = np.random.default_rng(block)
    lengths = [0, 5, 0, 0, 17, 1, 3, 0]
    # bytes that look like the separator at odd places, and halves of it
    pool = [i for i in (0x50C4, 0xC450 - 1, 0xC4C4, 0x5050, 0xC400, 0x0050, 258, 1, 256, 0xBBEF) if i != separator]
    ids = [rng.choice(pool, n).astype("<u4") for n in lengths]
    ids[1][:2] = [0xBBEF, 0x11BF]
    docs = spark.createDataFrame([(i.tobytes(), k) for k, i in enumerate(ids)] + [(None, 8)], "ids binary, file long").coalesce(1)
    token_scan.write_token_files(token_scan.narrow(docs, separator=separator), f"{tmp_path}/t", separator=separator)
    (file,) = list((tmp_path / "t").glob("part-*"))
    flat = np.frombuffer(file.read_bytes(), "<u2")
    assert flat.tolist() == [x for i in ids for x in [*i.tolist(), separator]] + [separator]
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "a.bin").write_bytes(flat.tobytes() + np.array([7, 8], "<u2").tobytes())
    (tmp_path / "open" / "b.bin").write_bytes(b"")
    (tmp_path / "open" / "c.bin").write_bytes(flat[1:].tobytes())  # begins as a byte order mark does
    (tmp_path / "open" / "d.bin").write_bytes(np.array([7, 8, 9], "<u2").tobytes())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        small_blocks(spark, block)
        found = sorted((r.file, r.ordinal, r.start, r.n_tokens, r.closed) for r in token_scan.document_lengths(spark, f"{tmp_path}/open", separator).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = []
    for name, sizes in (("a.bin", [*lengths, 0, 2]), ("c.bin", [*lengths[1:], 0]), ("d.bin", [3])):
        starts = np.concatenate([[0], np.cumsum([n + 1 for n in sizes])]).tolist()
        want += [(name, i, starts[i], n, not (name in ("a.bin", "d.bin") and i == len(sizes) - 1)) for i, n in enumerate(sizes)]
    assert found == want


def test_scan_edges(spark, tmp_path):
    docs = spark.createDataFrame([(np.array([50256], "<u4").tobytes(),)], "ids binary")
    with pytest.raises(Exception, match="separator"):
        token_scan.narrow(docs).collect()
    with pytest.raises(Exception, match="separator"):
        bpe.encode(spark.sql("select 'Hello' as text"), RANKS, PATTERN, bits=16, never=15496).collect()
    token_scan.write_token_files(docs.limit(0), f"{tmp_path}/none")
    assert token_scan.document_lengths(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number"):
        token_scan.document_lengths(spark, f"{tmp_path}/odd").collect()


def test_scan_finds_each_row_again(spark, tmp_path):
    docs = spark.range(1000).repartition(3).selectExpr("id", "'clash' as file", "repeat('a b ', cast(id % 50 as int)) as text")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    token_scan.write_token_files(bpe.encode(docs, RANKS, PATTERN, bits=16, never=50256, keep=["file"]), f"{tmp_path}/t", rows_a_file=100)
    at = token_scan.places(docs, "id", rows_a_file=100)
    found = token_scan.with_documents(token_scan.document_lengths(spark, f"{tmp_path}/t"), at).collect()
    enc = bpe.encoding(RANKS, PATTERN)
    assert {r.id: r.n_tokens for r in found} == {i: len(enc.encode_ordinary("a b " * (i % 50))) for i in range(1000)}
    with pytest.raises(Exception, match="differ"):
        token_scan.with_documents(token_scan.document_lengths(spark, f"{tmp_path}/t"), at.where("id <> 5")).collect()


def test_queries_agree_with_the_library(spark, data):
    from eventlake.llm.queries import op5_byte_bpe, op8_separator_scan

    enc = bpe.encoding(RANKS, PATTERN)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {i: np.array(enc.encode_ordinary(t), "<u4") for i, t in docs.items()}
    for r in op5_byte_bpe(spark, data).collect():
        want = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in op8_separator_scan(spark, data).collect()} == {i: len(x) for i, x in ids.items()}
    assert public_tokenizers.PATTERN == PATTERN
