"""Centroid clustering (Lloyd's rounds) by filtering over kd-trees.

Each partition of the vectors is cut into trees of up to ``TREE`` rows, once. A
node holds its rows' count, their exact integer sum and their bounding box. In a
round centroids walk down the trees: a centroid that is strictly farther than
another one from every point of a node's box can't win any row below it. A node
with one centroid left is assigned as a whole by its count and sum; leaves with
more are resolved row by row. All comparisons are between integers, so ties are
true ties and go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import need_columns, written
from .vectors import Gatherer, matrices, narrowest, products, quantised, split_in_two

#: Rows of a tree and of a leaf; elements of the arrays that one step over nodes, or rows, and centroids makes.
TREE, LEAF, ELEMENTS = 8192, 32, 1 << 20
FAR = np.iinfo(np.int64).max
RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
TREES = "dim int, width int, ids binary, lost binary, vectors binary, nodes binary, sums binary, low binary, high binary"


def kd_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, sums, low, high) over the rows of a matrix; a node is (first, last, left, right) within order, without children -1."""
    order, nodes, sums, low, high = np.arange(len(x)), [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        first, last, parent, side = todo.pop()
        part = x[order[first:last]]
        least, largest = part.min(axis=0), part.max(axis=0)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([first, last, -1, -1])
        sums.append(part.sum(axis=0, dtype=np.int64))
        low.append(least)
        high.append(largest)
        wide = largest.astype(np.int64) - least
        if last - first > leaf and wide.max(initial=0) > 0:
            below, above = split_in_two(part[:, wide.argmax()])
            mine = order[first:last].copy()
            order[first : first + len(below)], order[first + len(below) : last] = mine[below], mine[above]
            at = len(nodes) - 1
            todo += [(first + len(below), last, at, 1), (first, first + len(below), at, 0)]
    return order, np.array(nodes, "<i4"), np.array(sums, "<i8"), np.array(low), np.array(high)


def _build(dim: int, scale: float, tree: int, leaf: int):
    def packed(x: np.ndarray, ids: np.ndarray, lost: np.ndarray) -> pa.RecordBatch:
        x = narrowest(x)
        order, nodes, sums, low, high = kd_tree(x, leaf)
        row = [dim, x.itemsize, ids[order].astype("<i8"), lost[order], x[order], nodes, sums, low.astype(x.dtype), high.astype(x.dtype)]
        columns = [pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for v in row]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TREES.split(", ")])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gatherer(tree)
        for batch in rows:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            lost = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for places, x in matrices(batch.column(1), scale):
                if x.shape[1] == dim:
                    for whole in gathered.add(x, ids[places], lost[places]):
                        yield packed(*whole)
        for whole in gathered.rest():
            yield packed(*whole)

    return run


def _unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in rows:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            dim, kind = r["dim"], f"<i{r['width']}"
            read = lambda name, kind: np.frombuffer(r[name], kind).reshape(-1, dim)  # noqa: B023, E731
            yield {
                "ids": np.frombuffer(r["ids"], "<i8"), "lost": np.frombuffer(r["lost"], bool), "vectors": read("vectors", kind),
                "nodes": np.frombuffer(r["nodes"], "<i4").reshape(-1, 4), "sums": read("sums", "<i8"), "low": read("low", kind).astype(np.int64), "high": read("high", kind).astype(np.int64),
            }


def left_over(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which of the centroids that are open for each box aren't strictly dominated in it.

    The one nearest to the box's middle is held against each other one at the
    corner that favours the other most: if it is nearer even there, it is nearer
    at every point of the box.
    """
    middle = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
    best = centroids[np.where(open_, middle, FAR).argmin(axis=1)][:, None]
    corner = np.where(centroids[None] > best, high[:, None], low[:, None])
    # |other - corner|^2 - |best - corner|^2
    behind = ((centroids[None] - best) * (centroids[None] + best - 2 * corner)).sum(axis=2)
    return open_ & (behind <= 0)


def nearest(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Number of the nearest open centroid of each row, the smallest of several."""
    # |x|^2 is the same for all of a row's centroids
    far = (centroids**2).sum(axis=1)[None] - 2 * products(x, centroids)
    return np.where(open_, far, FAR).argmin(axis=1)


def filtered(tree: dict, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, their centroid, True) of nodes that are assigned whole, and (rows, their centroid, False) of rows that are resolved one by one."""
    k, dim = centroids.shape
    step = max(1, ELEMENTS // max(1, k * dim))
    level, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(level):
        below, still = [], []
        for at in range(0, len(level), step):
            some = level[at : at + step]
            left = left_over(tree["low"][some], tree["high"][some], centroids, open_[at : at + step])
            one = left.sum(axis=1) == 1
            if one.any():
                yield some[one], left[one].argmax(axis=1), True
            some, left = some[~one], left[~one]
            nodes = tree["nodes"][some]
            leaf = nodes[:, 2] < 0
            if leaf.any():
                sizes = nodes[leaf, 1] - nodes[leaf, 0]
                ends = np.cumsum(sizes)
                rows = np.arange(ends[-1]) + np.repeat(nodes[leaf, 0] - ends + sizes, sizes)
                of = np.repeat(np.flatnonzero(leaf), sizes)
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    yield part, nearest(tree["vectors"][part], centroids, left[of[i : i + step]]), False
            below += [nodes[~leaf, 2], nodes[~leaf, 3]]
            still += [left[~leaf], left[~leaf]]
        level, open_ = np.concatenate(below).astype(np.int64), np.concatenate(still)


def _totals(centroids: np.ndarray):
    """Per partition of trees and centroid: place 0 the number of vectors, behind it the sum of each component."""
    k, dim = centroids.shape

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for tree in _unpacked(rows):
            for which, cluster, whole in filtered(tree, centroids):
                if whole:
                    counts, sums = tree["nodes"][which, 1] - tree["nodes"][which, 0], tree["sums"][which]
                else:
                    counts, sums = np.ones(len(which), np.int64), tree["vectors"][which].astype(np.int64)
                for c in np.unique(cluster):
                    own = cluster == c
                    total[c, 0] += counts[own].sum()
                    total[c, 1:] += sums[own].sum(axis=0)
        cluster, place = np.divmod(np.arange(total.size), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(total.reshape(-1))], ["cluster", "place", "value"])

    return run


def _assigned(centroids: np.ndarray):
    """(id, cluster, distance) of each vector."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _unpacked(rows):
            cluster = np.zeros(len(tree["ids"]), np.int32)
            for which, found, whole in filtered(tree, centroids):
                if whole:
                    for (first, last), c in zip(tree["nodes"][which, :2], found):
                        cluster[first:last] = c
                else:
                    cluster[which] = found
            distance = ((tree["vectors"].astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], mask=tree["lost"]), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, none null or non-finite."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, real), F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int, scale: float) -> np.ndarray:
    """The quantised vectors of the k smallest sha256("seed:id"), in this order; of rows that share an id the smallest vectors come first. vectors: (id, vector)."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).select(code.alias("code"), "vector").orderBy("code", "vector").limit(k).collect()
    return quantised(np.array([r.vector for r in rows], float).reshape(len(rows), dim), scale)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: float = 1024, tree: int = TREE, leaf: int = LEAF
) -> DataFrame:
    """Every usable vector's (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Usable are vectors of exactly ``dim`` components, none null or non-finite; others give no row.
    Components become floor(scale * x), cut at 2**29 / sqrt(dim) either way. Centroids 0, 1, ... are at
    first the vectors of the k smallest sha256 of "seed:id". Each round assigns every vector to the
    nearest (squared Euclidean distance, ties to the smaller number) and replaces each non-empty
    centroid by floor(sum / count) of each component; after the last one vectors are assigned once
    more. Inertias are sums of distances, cut at 2**63 - 1. Rows with a null id are clustered and
    keep it, but are no first centroid. Repeated rows count each, and where they share an id
    may be several first centroids. Fewer vectors than k: as many centroids as there are; none, or
    an empty table: no rows. Other columns are ignored. The driver gets k * (dim + 1) numbers a round.
    """
    need_columns(vectors, id_col, vector_col)
    if id_col in RESULT:
        raise ValueError(f"{id_col} is the name of a result column")
    spark: SparkSession = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector is not null")
    trees = written(slim.mapInArrow(_build(dim, scale, tree, leaf), TREES), "kd-trees")
    centroids = first_centroids(slim, k, seed, dim, scale)
    out = "id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("id", id_col)
    needed = trees.select(*(c.split()[0] for c in TREES.split(", ")))
    for _ in range(rounds):
        parts = needed.mapInArrow(_totals(centroids), "cluster long, place long, value long")
        total = np.zeros((len(centroids), dim + 1), object)
        for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            total[r.cluster, r.place] = int(r.value)
        centroids = np.array([[s // t[0] for s in t[1:]] if t[0] else c.tolist() for c, t in zip(centroids, total)], np.int64).reshape(len(centroids), dim)
    assigned = needed.mapInArrow(_assigned(centroids), out)
    most = (1 << 63) - 1
    inertia = dict.fromkeys(range(len(centroids)), 0) | {r.cluster: int(r.sum) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    own = of([min(inertia[c], most) for c in range(len(centroids))]).cast("long")
    codes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.select(
        F.col("id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), F.lit(min(sum(inertia.values()), most)).cast("long").alias("inertia"), of(codes).alias("centroid_sha256")
    )
