"""Vectorised word and shingle hashing shared by the text operators.

Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r`` (the class
``[^\\x20\\x09-\\x0D]+`` over UTF-8 text, so code points are never cut). All
functions work on bounded pieces: a text longer than ``PIECE`` bytes is hashed
piece by piece, cut between words, and only the eight bytes a word remain.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _room(n: int) -> int:
    """n rounded up to a power of two, so that the power tables are seldom rebuilt."""
    return max(PIECE + 1, 1 << n.bit_length())


def _hash_piece(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one buffer."""
    a = np.frombuffer(buf, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.empty(len(a) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[a], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(_room(len(a)))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def _cuts(buf: bytes) -> list[int]:
    """Ends of pieces of about PIECE bytes, each just behind a space or at the end."""
    ends, at = [], 0
    while len(buf) - at > PIECE:
        cut = max(buf.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut < 0:  # one word longer than a piece: go on to its end
            found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (i := buf.find(c, at + PIECE)) >= 0]
            cut = min(found, default=len(buf) - 1)
        at = cut + 1
        ends.append(at)
    return [*ends, len(buf)] if at < len(buf) else ends


def ranges(sizes: list[int], size: int = PIECE):
    """(first, last) ranges of texts of so many bytes each that hold about ``size`` bytes together."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield first, i
            first, held = i, 0
        held += n + 1
    if first < len(sizes):
        yield first, len(sizes)


def batches(texts: list[bytes], size: int = PIECE):
    """(first, last) ranges of texts that hold about ``size`` bytes together."""
    return ranges([len(t) for t in texts], size)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's bounds in them (len(texts) + 1)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, j in batches(texts):
        if j == i + 1 and len(texts[i]) > PIECE:
            at = 0
            for end in _cuts(texts[i]):
                h, _ = _hash_piece(texts[i][at:end])
                hashes.append(h)
                counts[i] += len(h)
                at = end
            continue
        h, start = _hash_piece(b"\n".join(texts[i:j]))
        first = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts[i:j]], out=first[1:])
        counts[i:j] = np.diff(np.searchsorted(start, first))
        hashes.append(h)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word shingle in order; fewer words than k make one of all of them."""
    n = len(words)
    if not n:
        return words
    w = min(k, n)
    acc = words[: n - w + 1].copy()
    for i in range(1, w):
        acc *= np.uint64(0xA24BAED4963EE407)
        acc += words[i : n - w + 1 + i]
    return mix(acc + np.uint64(w))
