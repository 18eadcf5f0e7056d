"""Hard negatives and clusters against brute force over plain Python integers."""

import hashlib
from math import floor

import numpy as np
import pytest

from eventlake.llm import clusters, negatives
from eventlake.llm.queries import op11_ball_tree_negatives, op12_kd_tree_clusters
from eventlake.llm.vectors import most, products

ROWS = "vec_id long, label int, embedding array<float>"


def real(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_negatives(rows, anchor, positives=5, negatives_=10, low=30, high=90, scale=256):
    kept = [(i, label, [max(-most(len(v)), min(most(len(v)), floor(scale * x))) for x in v]) for i, label, v in rows if i is not None and label is not None and real(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    own = {}
    for i, label, v in kept:
        if anchor(i):
            own[i] = min(own.get(i, (label, len(v), v)), (label, len(v), v), key=lambda t: (t[0], t[1], np.array(t[2], "<i8").tobytes()))
    out = []
    for a, (label, dim, v) in own.items():
        scored = [(-dot(v, w), i, m) for i, m, w in kept if len(w) == dim]
        best = sorted(x for x in scored if x[2] == label and x[1] != a)[:positives]
        for p, b, _ in best:
            fits = sorted(x for x in scored if x[2] != label and -low * p <= -100 * x[0] <= -high * p)[:negatives_]
            out += [(a, b, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits)]
    return sorted(out)


def brute_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, np.array([floor(1024 * x) for x in v], object)) for i, v in rows if real(v) and len(v) == dim]
    first = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), list(v), v) for i, v in kept if i is not None), key=lambda t: t[:2])
    centroids = [t[2] for t in first[:k]]
    for turn in range(rounds + 1):
        of = [min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centroids)):
                own = [v for (_, v), (_, n) in zip(kept, of) if n == c]
                if own:
                    centroids[c] = np.array([s // len(own) for s in sum(own)], object)
    total = [sum(d for d, n in of if n == c) for c in range(len(centroids))]
    code = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, total[n], sum(total), code[n]) for (i, _), (d, n) in zip(kept, of))


def negatives_of(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def clusters_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def sample(n, dim, seed, spread=0.2):
    """Vectors around a few centres, on a coarse grid so that scores and distances tie, some of them alike."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = np.round((centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, dim))) * 4) / 4
    x[rng.integers(0, n, n // 5)] = x[0]
    return [(int(i), int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]


ODD = [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (510, 1, None), (520, 1, [1.0] * 5 + [None]), (530, 1, [float("nan")] + [1.0] * 5), (540, 1, [float("inf")] + [1.0] * 5), (550, 1, []), (560, 2, []), (570, 1, [])]


@pytest.mark.parametrize(("tree", "leaf", "block"), [(8192, 128, 8192), (40, 4, 7), (1, 1, 1)])
def test_negatives(spark, tree, leaf, block):
    rows = [*sample(230, 6, 1), *ODD, (600, 2, [3.0, 4.0]), (601, 2, [1.0, 1.0]), (602, 0, [1.0, 2.0]), (610, 1, [3e38] * 6), (611, 1, [-3e38] * 6)]
    rows += [rows[3], rows[10], rows[10], (20, 2, [0.5] * 6)]  # repeated rows, an anchor of two labels
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as id", "'x' as vector", "0 as rank").repartition(3)
    found = negatives.mine(df, df.vec_id % 10 == 0, tree=tree, leaf=leaf, block=block)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives_of(found) == want and len(want) > 500


def test_no_negatives(spark):
    none = spark.createDataFrame([], ROWS)
    assert negatives.mine(none, none.vec_id % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], ROWS)
    assert negatives.mine(one, one.vec_id % 10 == 0).collect() == []
    with pytest.raises(ValueError, match="label"):
        negatives.mine(one.drop("label"), one.vec_id % 10 == 0)


def test_nodes_are_left_out():
    """Far balls are pruned, and what is pruned can't matter: every row of a node lies within its bounds."""
    x = (np.array([v for _, _, v in sample(2000, 6, 5)]) * 256).astype(np.int64)
    order, nodes, centres, radii = negatives.ball_tree(x, 16)
    tree = {"ids": order, "labels": order % 3, "vectors": x[order], "nodes": nodes, "centres": centres, "radii": radii}
    s = negatives.Searches(np.arange(20), np.arange(20) % 3, x[:20], np.full((20, 1), negatives.LEAST), np.full((20, 1), np.iinfo(np.int64).max), 5, True)
    for n, (first, last, _, _) in enumerate(nodes):
        low, high = s._bounds(tree, n, np.arange(20))
        scores = products(s.x, tree["vectors"][first:last])
        assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
    seen, leaf = [], s._leaf
    s._leaf = lambda tree, rows, some: (seen.append(len(some)), leaf(tree, rows, some))
    s.walk(tree)
    assert 0 < sum(seen) < 20 * (nodes[:, 2] < 0).sum() / 2


def test_exact_products():
    a = np.array([[most(2), -most(2)], [1, 2]])
    assert products(a, a).tolist() == [[2 * most(2) ** 2, -most(2)], [-most(2), 5]]


@pytest.mark.parametrize(("tree", "leaf"), [(8192, 32), (50, 1), (1, 1)])
def test_clusters(spark, tree, leaf):
    rows = [(i, v) for i, _, v in [*sample(300, 6, 2), *ODD, (600, 2, [3.0, 4.0])]]
    rows += [rows[5], rows[5], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as cluster", "'x' as vector").repartition(3)
    assert clusters_of(clusters.cluster(df, dim=6, tree=tree, leaf=leaf)) == brute_clusters(rows, dim=6)


def test_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert clusters.cluster(none).collect() == []
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [9.0, 9.0]), (3, [0.75, -0.75])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters_of(clusters.cluster(df, dim=2)) == brute_clusters(rows, dim=2)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e300, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(r.cluster for r in clusters.cluster(huge, k=1, dim=2).collect()) == [0, 0, 0]


def test_strictly_dominated():
    """No centroid that is nearest to a point of the box, if only in a tie, is left out."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        low = rng.integers(-4, 4, (1, 2))
        high = low + rng.integers(0, 4, (1, 2))
        z = rng.integers(-6, 7, (5, 2))
        left = clusters.left_over(low, high, z, np.ones((1, 5), bool))[0]
        for x in range(low[0, 0], high[0, 0] + 1):
            for y in range(low[0, 1], high[0, 1] + 1):
                far = ((z - [x, y]) ** 2).sum(axis=1)
                assert left[far == far.min()].all()


def test_queries(spark, data):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert negatives_of(op11_ball_tree_negatives(spark, data)) == brute_negatives(moved, lambda i: i % 100 == 0)
    assert clusters_of(op12_kd_tree_clusters(spark, data)) == brute_clusters([(i, v) for i, _, v in rows])
