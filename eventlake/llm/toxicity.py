"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own bucket and those of its character n-grams, hashed; its vector
is the mean of their embeddings, a window's vector the mean of its distinct words', and a
softmax over a linear map of it gives the probability of label 1. Embeddings and
map are trained together by gradient descent (Adagrad) on windows of a bounded
sample of labelled texts. A label belongs to a whole text, which is toxic if any
window is: windows of toxic texts that don't look toxic so far are left out, more
strictly from round to round, and a text's score is its largest window's.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import need_columns, unused

BUCKETS, DIMS, GRAMS, WINDOW = 1 << 17, 8, (3, 4, 5), 16
#: A bag of fewer distinct words is averaged as if it had so many: one word, however often repeated, is weak evidence.
FEW = 8
#: How many clean windows a toxic one counts as in training; there are far fewer of them.
TOXIC_WEIGHT = 3.0
#: Windows a step of descent; steps of each round, and their rate.
BATCH, STEPS, RATE = 512, (400, 200, 200, 200, 200, 200, 200, 200), 0.6
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets(word: str) -> list[int]:
    """The hashed buckets of a word and of its character n-grams with end marks."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


@dataclass
class Model:
    """What scoring needs: each bucket's part of the difference of the two logits, and the bias."""

    weight: np.ndarray
    bias: float


class _WordScores(dict):
    """A word's part of the logit, kept for the words met (forgotten when there are too many)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= 400_000:
            self.clear()
        value = float(self.model.weight[buckets(word)].mean())
        if len(word) <= 64:
            self[word] = value
        return value


def _logit(model: Model, known: _WordScores, text: str) -> float:
    found = words_of(text)
    if not found:
        return model.bias
    get = known.__getitem__
    bags = (set(found[i : i + WINDOW]) for i in range(0, len(found), WINDOW))
    return max(sum(map(get, bag)) / max(len(bag), FEW) for bag in bags) + model.bias


def fit(texts: list[str], labels: list[int], seed: int = 1, steps: tuple[int, ...] = STEPS, rate: float = RATE) -> Model:
    """Train on a list of texts. Without texts of both labels: a constant score."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if len(y) and y.all() else -4.0)
    ids: dict[str, int] = {}
    grid, owner = array("i"), array("i")
    for d, text in enumerate(texts):
        found = [ids.setdefault(w, len(ids)) for w in words_of(text)]
        for i in range(0, len(found), WINDOW):
            part = list(dict.fromkeys(found[i : i + WINDOW]))
            grid.extend(part + [-1] * (WINDOW - len(part)))
            owner.append(d)
    flat, size = array("i"), array("i")
    for w in ids:
        own = buckets(w)
        flat.extend(own)
        size.append(len(own))
    del ids
    grid, owner = np.frombuffer(grid, np.int32).reshape(-1, WINDOW), np.frombuffer(owner, np.int32)
    size = np.frombuffer(size, np.int32).astype(np.int64)
    first = np.cumsum(size) - size
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))  # only buckets that some text shows are trained
    short = np.zeros(BUCKETS, np.int32)
    short[used] = np.arange(len(used))
    flat = short[np.frombuffer(flat, np.int32)]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (DIMS, len(used))).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32), np.zeros(2, np.float32)
    memory = [np.full_like(p, 1e-6) for p in (emb, out, bias)]
    target = y[owner]
    local = np.empty(len(used), np.int64)  # a step's buckets in a short list

    def descend(at: np.ndarray) -> None:
        part, aim = grid[at], target[at]
        held, place = np.unique(part, return_inverse=True)  # a step's distinct words; the first may stand for no word
        place = place.reshape(part.shape)
        held = np.maximum(held, 0)
        n = size[held]
        start = np.cumsum(n) - n
        feats = flat[np.repeat(first[held] - start, n) + np.arange(n.sum())]
        vec = (np.add.reduceat(emb[:, feats], start, axis=1) / n).T
        there = part >= 0
        count = np.maximum(there.sum(1), FEW)[:, None].astype(np.float32)
        hidden = np.where(there[:, :, None], vec[place], 0).sum(1) / count
        z = hidden @ out + bias
        e = np.exp(z - z.max(1, keepdims=True))
        share = np.where(aim, TOXIC_WEIGHT, 1.0)[:, None]
        dz = ((e / e.sum(1, keepdims=True) - np.eye(2)[aim.astype(int)]) * share / share.sum()).astype(np.float32)
        dh = np.repeat((dz @ out.T) / count, WINDOW, axis=0)[there.ravel()]
        word = place[there]
        seen = np.zeros(len(used), bool)
        seen[feats] = True
        which = np.flatnonzero(seen)
        local[which] = np.arange(len(which))
        feats = local[feats]
        for k in range(DIMS):
            dv = np.bincount(word, dh[:, k], len(held)) / n
            grad = np.bincount(feats, np.repeat(dv, n), len(which)).astype(np.float32)
            total = memory[0][k][which] + grad * grad
            memory[0][k][which] = total
            emb[k][which] -= rate * grad / np.sqrt(total)
        for k, (param, grad) in enumerate(((out, hidden.T @ dz), (bias, dz.sum(0))), 1):
            memory[k] += grad * grad
            param -= rate * grad / np.sqrt(memory[k])

    def difference() -> tuple[np.ndarray, float]:
        """Each bucket's part of the difference of the two logits, and the biases' difference."""
        return (out[:, 1] - out[:, 0]) @ emb, float(bias[1] - bias[0])

    active = np.arange(len(grid))
    for turn, n in enumerate(steps):
        if turn:
            part, base = difference()
            word = np.append(np.add.reduceat(part[flat], first) / size, 0).astype(np.float32)  # the last stands for no word
            p = 1 / (1 + np.exp(-np.clip(word[grid].sum(1) / np.maximum((grid >= 0).sum(1), FEW) + base, -60, 60)))
            best = np.zeros(len(y))
            np.maximum.at(best, owner, p)
            # of toxic texts the windows that look most toxic, of clean ones those that look toxic at all, and a share of the rest
            sharp = target & (p >= np.minimum(0.9 * best[owner], 0.9))
            active = np.flatnonzero(sharp | (~target & ((p > 0.03) | (rng.random(len(p)) < 0.15))))
        done = 0
        while done < n:
            shuffled = rng.permutation(active)
            for i in range(0, len(shuffled), BATCH):
                descend(np.sort(shuffled[i : i + BATCH]))
                done += 1
                if done >= n:
                    break
    weight = np.zeros(BUCKETS, np.float32)  # what no text showed says nothing
    weight[used], base = difference()
    return Model(weight, base)


def held_out(id_col: str):
    """Column: crc32 of the id as text leaves 2 modulo 4; such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1000, most_clean: int = 6000, most_chars: int = 40_000_000
) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out.

    At most most_toxic rows of label 1 and most_clean of label 0 come to one
    task, chosen by a hash of the id, whole texts each; where they exceed
    most_chars code points together, the longest are left out. Null labels, ids
    and texts, and texts without a word, don't count; a repeated label row counts
    once; a repeated id gives the least of its texts. Only the model comes to the
    driver, neither texts nor what training holds. Without rows, or with those
    of one label only, scores are constant.
    """
    need_columns(docs, id_col, text_col)
    need_columns(labels, id_col, label_col)
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    pick = lambda v, n: marks.where(F.col("_label") == v).distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = pick(1, most_toxic).union(pick(0, most_clean))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    rows = found.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    so_far = F.sum(F.length("_text")).over(Window.orderBy(F.length("_text"), "_id", "_label").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over the few thousand chosen rows
    rows = rows.where(F.length("_text") <= most_chars).withColumn("_sum", so_far).where(F.col("_sum") <= most_chars).drop("_sum")
    made = rows.mapInArrow(_fitted, "weight binary, bias double").toArrow().to_pylist()  # the window has brought them into one task
    return Model(np.frombuffer(made[0]["weight"], np.float32), made[0]["bias"]) if made else fit([], [])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model that the rows (id, label, text) of all batches give, in the order of their values."""
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    texts, marks = [r[2] for r in rows], [r[1] for r in rows]
    if not rows:
        return
    del rows
    model = fit(texts, marks)
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([float(model.bias)])], ["weight", "bias"])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the probability (0 to 1) that the whole text is toxic.

    Null, empty and wordless texts get the model's bias alone. Nothing but the
    text enters. Other columns stay (one named score_col is replaced); equal
    texts score equally; an empty table stays empty.
    """
    need_columns(docs, text_col)
    kept = docs.drop(score_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordScores(shipped.value)
        for batch in rows:
            logits = np.array([_logit(shipped.value, known, t or "") for t in batch.column(text_col).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -60, 60))))], [*batch.schema.names, score_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(score_col, DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    (name,) = unused(docs, "_score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)
