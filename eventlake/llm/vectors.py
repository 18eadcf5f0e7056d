"""Integer vectors shared by the vector operators: read from list columns, packed, and multiplied exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa


def most(dim: int) -> int:
    """Largest size of a component: inner products and squared distances of vectors within it fit into 64 bits."""
    return isqrt((1 << 60) // max(dim, 1)) >> 1


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles as integers, cut at ``most`` either way."""
    dim = x.shape[1]
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -most(dim), most(dim)).astype(np.int64)


def matrices(column: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, quantised vectors) of a list column's rows, one matrix for each length; rows that are null or hold a null or non-finite component are left out."""
    offsets = column.offsets.to_numpy()
    x = column.values.to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    sizes = np.diff(offsets)
    for dim in np.unique(sizes[ok]).tolist():
        places = np.flatnonzero(ok & (sizes == dim))
        yield places, quantised(x[offsets[places][:, None] + np.arange(dim)], scale)


def narrowest(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest of 16, 32 and 64 bits that holds them."""
    far = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if far < 1 << 15 else "<i4" if far < 1 << 31 else "<i8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices; in floating point only where that is exact."""
    far = [int(np.abs(m).max(initial=0)) for m in (a, b)]
    if far[0] * far[1] * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def split_in_two(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lower and the upper half of values, each in ascending order of place."""
    half = len(part) // 2
    order = np.argpartition(part, half)
    return np.sort(order[:half]), np.sort(order[half:])


class Gatherer:
    """Rows of vectors gathered by length until there are ``size`` of one, which then go on together."""

    def __init__(self, size: int):
        self.size, self.held, self.rows = size, {}, {}

    def add(self, vectors: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        dim = vectors.shape[1]
        self.held.setdefault(dim, []).append((vectors, *columns))
        self.rows[dim] = self.rows.get(dim, 0) + len(vectors)
        if self.rows[dim] >= self.size:
            whole = [np.concatenate(c) for c in zip(*self.held[dim])]
            full = self.rows[dim] // self.size * self.size
            for at in range(0, full, self.size):
                yield tuple(c[at : at + self.size] for c in whole)
            self.held[dim], self.rows[dim] = [tuple(c[full:] for c in whole)], self.rows[dim] - full

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        for dim, parts in self.held.items():
            if self.rows[dim]:
                yield tuple(np.concatenate(c) for c in zip(*parts))
