"""Huffman-coded token files: codes against their definition, files as round trips, texts against the library."""

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eventlake.llm import token_output as to
from eventlake.llm.queries import END, TOKENIZER, op13_huffman_token_files

TEXTS = ["", None, "Hello world's  \n\n  end ", "déjà vu — ñandú 漢字 🙂🙂", "x" * 3000, " \t\n" * 50, "a b\x1c c\x85 d  e", "<|endoftext|> 's # 12345 ...", "long words here \n" * 9000, "a\t b  c\n\n d", "\n\n\n x \n \n y  ", "Hello\n\nworld\n!?\n", " I'll 's \nnot", "a\0b c", "\x00", "nb\xa0 sp \u3000 x"]


def plain():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, END]


def huffman_cost(n):
    heap = sorted(n)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(3)
    for size in (2, 3, 7, 100, 1000):
        n = rng.integers(1, 1000, size)
        free = to.code_lengths(n, 40)
        assert (n * free).sum() == huffman_cost(n.tolist())
        tight = to.code_lengths(n, (size - 1).bit_length())
        for lengths in (free, tight):
            assert sum(1 / 2.0**x for x in lengths) <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], np.int64)
    assert to.code_lengths(fib, 40).max() == 11
    # the best among all codes of at most five bits, found by trying them
    best = min((sum(int(a) * b for a, b in zip(fib[::-1], lengths)), lengths) for lengths in monotone(12, 5, 32))
    assert (fib * to.code_lengths(fib, 5)).sum() == best[0]
    assert to.code_lengths(np.array([], np.int64)).tolist() == [] and to.code_lengths(np.array([9])).tolist() == [1]


def monotone(n, most, room, least=1):
    """Ascending lengths that leave no prefix code out: the sum of 2^-length is 1."""
    if n == 0:
        if room == 0:
            yield []
        return
    for x in range(least, most + 1):
        if (32 >> x) * 1 <= room and n * (32 >> x) >= room:
            for rest in monotone(n - 1, most, room - (32 >> x), x):
                yield [x, *rest]


def test_canonical_codes():
    symbols, n = np.array([70000, 5, 9, 2, 4]), np.array([10, 1, 1, 5, 5])
    c = to.Codes(symbols, to.code_lengths(n))
    ids = np.random.default_rng(1).choice(symbols, 3000).astype(np.uint32)
    data, offsets, bits = c.encode(ids, 100)
    words = {int(s): f"{code:0{n}b}" for s, code, n in zip(c.symbols, c.codes.tolist(), c.lengths.tolist())}
    text = "".join(words[i] for i in ids.tolist())
    assert len(text) == bits and "".join(f"{b:08b}" for b in data).startswith(text) and len(data) == (bits + 7) // 8
    assert offsets.tolist() == [sum(len(words[i]) for i in ids[:k].tolist()) for k in range(0, 3000, 100)]
    ordered = sorted(words.items(), key=lambda w: (len(w[1]), w[0]))
    assert [w for _, w in ordered] == sorted(w for _, w in ordered)
    assert to.decode(data, offsets, 3000, c.width, c.table(), 100).tolist() == ids.tolist()
    with pytest.raises(ValueError, match="no code"):
        c.encode(np.array([3], np.uint32))


def ids_of(words, texts):
    ids, bounds = words.encode(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:])]


def test_words_are_the_library():
    words, one = to.Words(TOKENIZER), plain()
    for _ in range(2):
        assert ids_of(words, TEXTS) == [one(t)[:-1] for t in TEXTS]



def folder(spark, tmp_path, rows, **sizes):
    df = spark.createDataFrame([(i, None if x is None else np.array(x, "<u4").tobytes()) for i, x in rows], "id long, ids binary").repartition(3)
    to.write(df, f"{tmp_path}/t", **sizes)
    return df


@pytest.mark.parametrize(("chunk", "chunks_a_file", "part"), [(1 << 18, 32, 1 << 22), (700, 2, 2000), (1, 1, 100)])
def test_files(spark, tmp_path, chunk, chunks_a_file, part):
    rng = np.random.default_rng(chunk)
    rows = [(int(i), rng.choice([2, 7, 10, 13, 300, 70000], int(rng.integers(0, 400))).tolist()) for i in rng.permutation(60)]
    rows += [(None, [7]), (None, None), (5, [1, 1]), (5, [1, 1]), (-3, [10] * 5000), (99, [])]
    folder(spark, tmp_path, rows, chunk=chunk, chunks_a_file=chunks_a_file, part=part)
    back = [(r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in to.read(spark, f"{tmp_path}/t").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or [])
    want = sorted(((i, x or []) for i, x in rows), key=key)
    assert sorted(back, key=key) == want
    digests = sorted(to.digests(spark, f"{tmp_path}/t", "name").collect(), key=lambda r: (r.start, r.n_tokens))
    assert sorted(str(r.name) for r in digests) == sorted(str(i) for i, _ in rows)
    order = [-1 << 60 if r.name is None else r.name for r in digests if r.n_tokens]
    assert order == sorted(order)
    at = 0
    for r in (r for r in digests if r.n_tokens):
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in digests) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, x in want)


def test_parts_of_a_chunk(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(0, 50, 300).tolist()) for i in range(40)]
    folder(spark, tmp_path, rows)
    codes = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/codes").collect()]
    table = to.Codes(*(np.array(c) for c in zip(*codes))).table()
    (file,) = (tmp_path / "t" / "data").glob("part-*")
    (chunk,) = to.read_chunks(file.read_bytes())
    for first, last in ((0, 1), (5, 6), (17, 30), (39, 40), (39, 99), (40, 41), (3, 3)):
        assert [(i, x.tolist()) for i, _, x in to.documents_of(chunk, table, first, last)] == rows[first:last]
    raw = file.read_bytes()
    with pytest.raises(ValueError, match="Huffman"):
        list(to.read_chunks(b"x" * len(raw)))
    with pytest.raises(ValueError, match="cut off"):
        list(to.read_chunks(raw[:-1]))


def test_empty_folder(spark, tmp_path):
    folder(spark, tmp_path, [])
    assert to.digests(spark, f"{tmp_path}/t").collect() == []


def test_query(spark, data):
    one = plain()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op13_huffman_token_files(spark, data).collect()}
    at = 0
    for i, text in docs:
        ids = one(text)
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_any_texts():
    """Texts of a small alphabet that holds all that cuts depend on."""
    words, one, rng = to.Words(TOKENIZER), plain(), np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab  \n'sé1.,\t\xa0\0漢"), int(rng.integers(0, 30)))) for _ in range(4000)]
    got = [w for i in range(0, 4000, 500) for w in ids_of(words, texts[i : i + 500])]
    assert got == [one(t)[:-1] for t in texts]


@pytest.mark.parametrize("bits", [16, 32])
def test_widths(spark, tmp_path, bits):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    to.write(to.encode(docs, TOKENIZER, END, bits=bits), f"{tmp_path}/t", bits=bits)
    one = plain()
    assert {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in to.read(spark, f"{tmp_path}/t").collect()} == {1: one("one two"), 2: [END]}
    if bits == 16:
        with pytest.raises(Exception, match="more than 16 bits"):
            to.encode(docs, TOKENIZER, 1 << 16, bits=16).collect()


def test_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as id")
    one = plain()
    assert {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in to.encode(df, TOKENIZER, END).collect()} == {i: one(t) for i, t in enumerate(TEXTS)}
