"""Near-duplicates against brute force."""

import random

import numpy as np
import pytest

from eventlake.llm import graph, near_dup
from eventlake.llm.graph import components
from eventlake.llm.words import shingle_hashes, word_hashes


def brute(rows, k, percent):
    """Components over all pairs of exact shingle sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base = [], [fresh(n) for n in (3, 12, 80, 400)]
    for n, b in enumerate(base):
        for e in range(25):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(b) // 12)):
                w[rng.randrange(len(w))] = fresh(1)[0]
            rows.append((n * 100 + e, " ".join(w).upper() if e % 3 else "\n".join(w)))
    rows += [(1000 + i, " ".join(fresh(50))) for i in range(30)]
    return rows + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "one two three")]


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80)])
def test_matches_brute_force(spark, k, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert found == brute(rows, k, percent)


def test_deduplicated_keeps_one_of_each(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows] + [(1000, rows[100][1], "x", 1000), (None, "loose", "x", 1)], "doc_id long, text string, regs string, n long")
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, v in brute(rows, 5, 80).items() if v[2])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1


def test_one_large_group_and_empty(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same few words in every one of these texts' as text")
    assert {r.component_id for r in near_dup.near_duplicates(docs).collect()} == {0}
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[300:1300]  # 700 of 1300
    ra, rb = (near_dup.registers(near_dup.minima(x)) for x in (a, b))
    assert (near_dup.merge(ra, rb) == near_dup.registers(near_dup.minima(np.union1d(a, b)))).all()
    grid = np.linspace(0, 1, 101)[None, :]
    curve = near_dup.log_likelihood(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]), grid)
    assert abs(grid[0][curve.argmax()] - 700 / 1300) < 0.15


def test_hashes_do_not_depend_on_pieces():
    text = b"ab  cd\tefgh\n" * 300_000
    whole, bound = word_hashes([text, b"", b"ab"])
    assert bound.tolist() == [0, 900_000, 900_000, 900_001]
    assert whole[0] == whole[3] == whole[-1] and len(set(whole.tolist())) == 3
    assert len(shingle_hashes(whole[:2], 4)) == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert components(edges.limit(0)).collect() == []
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(chain).collect()} == {0}


@pytest.mark.parametrize("turns", [0, 2])
def test_crowd_of_near_copies_at_every_distance(spark, monkeypatch, turns):
    """One large group around the threshold, in buckets that are parted and meet by their rare shingles in the end: no link lost."""
    monkeypatch.setattr(near_dup, "CROWD", 4)
    monkeypatch.setattr(near_dup, "FEW", 1)
    monkeypatch.setattr(near_dup, "TURNS", turns)
    monkeypatch.setattr(near_dup, "crowd", lambda rows, least: 50)
    monkeypatch.setattr(graph, "crowd", lambda rows, least: 5)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{i}{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, rows[3][1]) for i in range(60)]  # one hot class of equal texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    want = brute(rows, 4, 80)
    assert len({v[1] for v in want.values()}) > 20 and found == want


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 60), (2, 95)])
def test_prefixes_lose_no_pair(spark, k, percent):
    """All pairs of different components at or above the similarity share a rare shingle, and few others do."""
    rng = random.Random(k)
    base, rows = [f"w{i}" for i in range(50)], [(900, "alone"), (901, "alone"), (902, "alone again")]
    for i in range(120):
        w = list(base)[: rng.randrange(30, 51)]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{i}{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)} for i, w in ((i, t.split()) for i, t in rows)}
    members = spark.createDataFrame([(i, len(sets[i]), i % 50) for i in sets], "id long, n long, component long")
    texts = spark.createDataFrame(rows, "id long, text string")
    found = {(r.a, r.b) for r in near_dup.sharing_rare(members, texts, k, percent).collect()}
    every = [(a, b) for a in sets for b in sets if a < b and a % 50 != b % 50]
    want = {(a, b) for a, b in every if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert want and want <= found and len(found) < len(every) / 2
