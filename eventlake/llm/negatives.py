"""Hard-negative mining by branch and bound over ball trees.

Each partition of the vectors is cut into trees of up to ``TREE`` rows; a node is
a ball (centre and radius) around its rows, so the inner product of an anchor with
any row of it lies within centre * anchor -+ radius * |anchor|. A node is left out
for an anchor when that interval misses the wanted window of scores, or ends
strictly beneath the anchor's current k-th best: ties must be looked at, as the
smaller id wins. Leaves are decided by exact integer products. Anchors go through
all trees in blocks of bounded size, which are broadcast one after the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import need_columns, new_path, written
from .vectors import Gatherer, matrices, narrowest, products, split_in_two

#: Rows of a tree, rows of a leaf, anchors that are broadcast together, and those that walk a tree together.
TREE, LEAF, BLOCK, WALK = 8192, 128, 8192, 1024
LEAST = np.iinfo(np.int64).min
TREES = "dim int, width int, ids binary, labels binary, vectors binary, nodes binary, centres binary, radii binary"
ANCHORS = "id long, label long, dim int, vector binary, block long"


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, centres, radii) over the rows of a matrix; a node is (first, last, left, right) within order, without children -1."""
    order, nodes, centres, radii = np.arange(len(x)), [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        first, last, parent, side = todo.pop()
        part = x[order[first:last]].astype(float)
        centre = part.mean(axis=0)
        far = ((part - centre) ** 2).sum(axis=1)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([first, last, -1, -1])
        centres.append(centre)
        # rounding: no row may lie outside of its ball
        radii.append(np.sqrt(far.max()) * (1 + 1e-9) + 1e-9 * np.abs(centre).max(initial=0))
        if last - first > leaf and far.max() > 0:
            one = part[far.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            low, high = split_in_two(part @ (other - one))
            mine = order[first:last].copy()
            order[first : first + len(low)], order[first + len(low) : last] = mine[low], mine[high]
            at = len(nodes) - 1
            todo += [(first + len(low), last, at, 1), (first, first + len(low), at, 0)]
    return order, np.array(nodes, "<i4"), np.array(centres, "<f8"), np.array(radii, "<f8")


def _rows(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, ids, labels) of a batch (id, label, vector), by length."""
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    for places, x in matrices(batch.column(2), scale):
        yield x, ids[places].astype(np.int64), labels[places].astype(np.int64)


def _build(scale: float, tree: int, leaf: int):
    def packed(x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        order, nodes, centres, radii = ball_tree(x, leaf)
        x = narrowest(x[order])
        row = [x.shape[1], x.itemsize, ids[order].astype("<i8"), labels[order].astype("<i8"), x, nodes, centres, radii]
        columns = [pa.array([v], pa.int32()) if isinstance(v, int) else pa.array([v.tobytes()], pa.binary()) for v in row]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TREES.split(", ")])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gatherer(tree)
        for batch in rows:
            for part in _rows(batch, scale):
                for whole in gathered.add(*part):
                    yield packed(*whole)
        for whole in gathered.rest():
            yield packed(*whole)

    return run


def _pack_anchors(scale: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for x, ids, labels in _rows(batch, scale):
                vectors = pa.array([v.tobytes() for v in x.astype("<i8")], pa.binary())
                dims = pa.array(np.full(len(ids), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), dims, vectors], ["id", "label", "dim", "vector"])

    return run


def _in_blocks(size: int):
    """Gives a partition's rows numbers of blocks that hold ``size`` rows at most."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, base = 0, TaskContext.get().partitionId() << 32
        for batch in rows:
            at = (np.arange(seen, seen + batch.num_rows) // size + base).astype(np.int64)
            seen += batch.num_rows
            yield batch.append_column("block", pa.array(at))

    return run


class Best:
    """The first k candidates (highest score, then smallest id) of each of many searches."""

    def __init__(self, searches: int, k: int):
        self.k = k
        self.scores = np.full((searches, k), LEAST, np.int64)
        self.ids = np.zeros((searches, k), np.int64)
        self.n = np.zeros(searches, np.int64)

    @property
    def kth(self) -> np.ndarray:
        """Scores below these can't be among the first k any more."""
        return self.scores[:, -1]

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(search)
        rows, at = np.nonzero(np.arange(self.k) < self.n[touched, None])
        old = touched[rows]
        search, score, ids = (np.concatenate(p) for p in ((old, search), (self.scores[old, at], score), (self.ids[old, at], ids)))
        order = np.lexsort((ids, -score, search))
        search, score, ids = search[order], score[order], ids[order]
        rank = np.arange(len(search)) - np.searchsorted(search, search)
        keep = rank < self.k
        search, rank = search[keep], rank[keep]
        self.scores[search, rank], self.ids[search, rank] = score[keep], ids[keep]
        np.maximum.at(self.n, search, rank + 1)


class Searches:
    """Anchors of one length with windows [low, high] of scores, one or more an anchor; their best rows, tree after tree.

    With ``same`` rows of the anchor's label other than itself are looked for,
    else rows of other labels.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.x, self.low, self.high, self.same = ids, labels, x, low, high, same
        self.windows = low.shape[1]
        self.best = Best(low.size, k)
        self.lengths = np.sqrt((x.astype(float) ** 2).sum(axis=1))

    def walk(self, tree: dict) -> None:
        for at in range(0, len(self.ids), WALK):
            self._node(tree, 0, np.arange(at, min(at + WALK, len(self.ids))))

    def _bounds(self, tree: dict, node: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of a node's rows; rounding errors widen them."""
        middle = self.x[some].astype(float) @ tree["centres"][node]
        reach = self.lengths[some] * tree["radii"][node]
        reach += 1e-9 * (reach + self.lengths[some] * np.sqrt((tree["centres"][node] ** 2).sum())) + 1e-6
        return middle - reach, middle + reach

    def _floor(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(self.low[some], self.best.kth.reshape(-1, self.windows)[some])

    def _node(self, tree: dict, node: int, some: np.ndarray) -> None:
        least, largest = self._bounds(tree, node, some)
        some = some[((largest[:, None] >= self._floor(some)) & (least[:, None] <= self.high[some])).any(axis=1)]
        if not len(some):
            return
        first, last, left, right = tree["nodes"][node]
        if left < 0:
            self._leaf(tree, slice(first, last), some)
            return
        # the child that promises more to most anchors first, so that the k-th best rises early
        upper = [self._bounds(tree, child, some)[1].sum() for child in (left, right)]
        for child in (left, right) if upper[0] >= upper[1] else (right, left):
            self._node(tree, child, some)

    def _leaf(self, tree: dict, rows: slice, some: np.ndarray) -> None:
        ids, labels = tree["ids"][rows], tree["labels"][rows]
        for at in range(0, len(ids), LEAF):
            part = slice(at, at + LEAF)
            scores = products(self.x[some], tree["vectors"][rows][part])
            alike = self.labels[some, None] == labels[None, part]
            fits = alike & (self.ids[some, None] != ids[None, part]) if self.same else ~alike
            floor = self._floor(some)
            found = [np.nonzero(fits & (scores >= floor[:, w, None]) & (scores <= self.high[some, w, None])) for w in range(self.windows)]
            search = np.concatenate([some[p] * self.windows + w for w, (p, _) in enumerate(found)])
            p, q = (np.concatenate(c) for c in zip(*found))
            if len(p):
                self.best.add(search, scores[p, q], ids[part][q])


def _unpacked(trees: pa.RecordBatch) -> Iterator[dict]:
    for r in trees.to_pylist():
        dim, read = r["dim"], lambda name, kind: np.frombuffer(r[name], kind)  # noqa: B023
        ids, nodes = read("ids", "<i8"), read("nodes", "<i4").reshape(-1, 4)
        yield {
            "dim": dim, "ids": ids, "labels": read("labels", "<i8"), "vectors": read("vectors", f"<i{r['width']}").reshape(len(ids), dim),
            "nodes": nodes, "centres": read("centres", "<f8").reshape(len(nodes), dim), "radii": read("radii", "<f8"),
        }


def _search(shared, k: int, same: bool):
    """Per partition of trees the best rows of each search: (dim, anchor, place, window, score, id)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = {dim: Searches(*arrays, k=k, same=same) for dim, arrays in shared.value.items()}
        for batch in rows:
            for at in range(batch.num_rows):
                for tree in _unpacked(batch.slice(at, 1)):
                    if tree["dim"] in all_:
                        all_[tree["dim"]].walk(tree)
        for dim, s in all_.items():
            search, at = np.nonzero(np.arange(k) < s.best.n[:, None])
            for i in range(0, len(search), 50_000):
                j, a = search[i : i + 50_000], at[i : i + 50_000]
                place, window = np.divmod(j, s.windows)
                columns = [np.full(len(j), dim), s.ids[place], place, window, s.best.scores[j, a], s.best.ids[j, a]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["dim", "anchor", "place", "window", "score", "id"])

    return run


def _first(trees: DataFrame, searches: dict, k: int, same: bool) -> DataFrame:
    """The first k rows of each search over all trees, with their rank; every partition brings k at most."""
    shared = trees.sparkSession.sparkContext.broadcast(searches)
    found = trees.mapInArrow(_search(shared, k, same), "dim long, anchor long, place long, window long, score long, id long")
    order = Window.partitionBy("dim", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _groups(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Blocks put together, smallest with largest, as long as they hold ``most`` rows at most."""
    open_: list[tuple[int, int, list[int]]] = []
    for n, block in sorted(((n, b) for b, n in sizes), reverse=True):
        if open_ and open_[0][0] + n <= most:
            held, key, blocks = heapq.heappop(open_)
            heapq.heappush(open_, (held + n, key, [*blocks, block]))
        else:
            heapq.heappush(open_, (n, block, [block]))
    yield from (blocks for _, _, blocks in open_)


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256,
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), tree: int = TREE, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's first positives and each one's first negatives.

    Components become floor(scale * x), cut at 2**29 / sqrt(length) either way, so that every
    score is an exact 64-bit integer. Positives are the anchor's best other rows of its label;
    negatives are the best rows of other labels whose score is within ``window`` percent of the
    positive's: window[0] * positive <= 100 * negative <= window[1] * positive. Higher scores come
    first, ties by smaller id. Rows with a null id, label or vector, or a null or non-finite
    component take no part. Vectors of different length don't meet. Repeated rows count each, as
    positives and negatives; anchors that share an id are one (that of the smallest label, then
    vector), and never their own positive. Fewer rows than wanted: all; none, or an empty
    table: no rows. is_anchor is a condition over vectors (null: none); other columns are ignored.

    Every anchor meets every tree that its bounds don't exclude: blocks of ``block``
    anchors are broadcast one after the other, with their windows; a partition gives
    ``negatives`` rows a search at most. Results of a block are written before the next one.
    """
    need_columns(vectors, id_col, label_col, vector_col)
    spark: SparkSession = vectors.sparkSession
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    slim = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")]
    trees = written(vectors.where(whole).select(*slim).mapInArrow(_build(scale, tree, leaf), TREES), "ball-trees")
    packed = vectors.where(whole & is_anchor).select(*slim).mapInArrow(_pack_anchors(scale), "id long, label long, dim int, vector binary")
    anchors = written(packed.groupBy("id").agg(F.min(F.struct("label", "dim", "vector")).alias("v")).select("id", "v.*"), "anchors")
    parts = max(1, -(-anchors.count() // block))
    anchors = written(anchors.repartition(parts).mapInArrow(_in_blocks(block), ANCHORS), "anchor-blocks")
    sizes = [tuple(r) for r in anchors.groupBy("block").count().collect()]  # a row for each block, none for an anchor
    path = new_path(spark, "negatives")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(f"{path}/turn=-1")
    for turn, blocks in enumerate(_groups(sizes, block)):
        by_dim: dict[int, list] = {}
        for r in anchors.where(F.col("block").isin(blocks)).collect():  # ``block`` anchors at most
            by_dim.setdefault(r.dim, []).append((r.id, r.label, np.frombuffer(r.vector, "<i8")))
        searches, held = {}, {}
        for dim, rows in by_dim.items():
            ids, labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
            x = np.stack([r[2] for r in rows]).reshape(len(rows), dim)
            held[dim] = (ids, labels, x)
            searches[dim] = (*held[dim], np.full((len(rows), 1), LEAST), np.full((len(rows), 1), -LEAST - 1))
        best = _first(trees, searches, positives, True).select("dim", "place", "rank", "id", "score").collect()  # positives * block rows at most
        found = spark.createDataFrame([(r.dim, r.place, r.rank - 1, r.id, r.score) for r in best], "dim long, place long, window long, positive_id long, positive_score long")
        low = {d: np.full((len(h[0]), positives), 1, np.int64) for d, h in held.items()}
        high = {d: np.zeros((len(h[0]), positives), np.int64) for d, h in held.items()}  # no positive: an empty window
        for r in best:
            low[r.dim][r.place, r.rank - 1] = -(-window[0] * r.score // 100)
            high[r.dim][r.place, r.rank - 1] = window[1] * r.score // 100
        mined = _first(trees, {d: (*h, low[d], high[d]) for d, h in held.items()}, negatives, False)
        mined = mined.join(F.broadcast(found), ["dim", "place", "window"])  # positives * block rows at most
        mined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/turn={turn}")
    return spark.read.option("basePath", path).schema(kinds).parquet(path).select(*(c.split()[0] for c in kinds.split(", ")))
