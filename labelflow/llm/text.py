"""Vectorised word and shingle hashing of whole batches of texts.

All functions work on the bytes of an Arrow binary column and treat documents
one after another in one buffer; nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C17)  # = 3 (mod 4): odd, with an inverse mod 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` or more powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def binary_parts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary Arrow array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets, valid


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Runs of documents (from, to) of about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def runs(texts: list[str], limit: int):
    """Runs (from, to) of texts of about ``limit`` characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end).

    Words are runs of bytes other than space and \\x09-\\x0D; A-Z count as a-z.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    a = data[base:end]
    at = offsets - base
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[a]
    start = ~space
    begins = at[:-1][at[:-1] < len(a)]
    keep = start[begins]
    start[1:] &= space[:-1]
    start[begins] = keep  # a word may begin right where a document does
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(len(a) + 1)
    v = _BYTE[a]
    v *= up[: len(a)]
    h = np.add.reduceat(v, starts) * down[starts]
    return mix(h), np.searchsorted(starts, at)


_K = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: np.ndarray, first: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each w-word shingle, first shingle of each document and the end).

    A document of 1 to w-1 words has one shingle, its whole word sequence; one
    without words has none.  Repeats are kept.
    """
    n = np.diff(first)
    many = np.where(n >= w, n - w + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(out_first[-1], np.uint64)
    if not len(words):
        return out, out_first
    if len(words) >= w:
        h = words[: len(words) - w + 1].copy()
        for k in range(1, w):
            h = h * _K + words[k : len(words) - w + 1 + k]
        h = mix(h)
        ok = np.ones(len(h) + w - 1, bool)  # positions where a shingle stays in its document
        for k in range(1, w):
            stop = first[1:] - k
            ok[stop[(stop >= first[:-1])]] = False
        ok = ok[: len(h)]
        whole = np.repeat(n >= w, many)
        out[whole] = h[ok]
    for m in range(1, w):
        docs = np.flatnonzero(n == m)
        if len(docs):
            h = np.full(len(docs), np.uint64(m))
            for k in range(m):
                h = h * _K + words[first[docs] + k]
            out[out_first[docs]] = mix(h ^ _K)
    return out, out_first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each document, and where each begins."""
    parts, sizes = [], np.zeros(len(first) - 1, np.int64)
    for d in range(len(first) - 1):
        x = values[first[d] : first[d + 1]]
        if len(x) > 1:
            x = np.sort(x)
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        parts.append(x)
        sizes[d] = len(x)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


class MinHasher:
    """``n`` minhashes of each set by multiply-add of well mixed 64-bit values."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def __call__(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One row per non-empty set, in order; a column per hash."""
        starts = first[:-1][np.diff(first) > 0]
        out = np.empty((len(starts), len(self.mul)), np.uint64)
        step = 1 << 15  # sets are taken in runs that stay in cache
        edges, i = [], 0
        while i < len(starts):
            j = int(np.searchsorted(starts, starts[i] + step, side="right"))
            edges.append((i, max(j, i + 1)))
            i = max(j, i + 1)
        for i, j in edges:
            lo = starts[i]
            hi = starts[j] if j < len(starts) else len(flat)
            x, at = flat[lo:hi], starts[i:j] - lo
            for k in range(len(self.mul)):
                out[i:j, k] = np.minimum.reduceat(x * self.mul[k] + self.add[k], at)
        return out


def fold(columns: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key of several minhash columns; ``salt`` tells tables apart."""
    h = np.full(len(columns), np.uint64(salt))
    for k in range(columns.shape[1]):
        h = mix(h * _K + columns[:, k])
    return h


def set_digest(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, independent of order; 0 for an empty set."""
    out = [np.zeros(len(first) - 1, np.uint64) for _ in range(2)]
    full = np.diff(first) > 0
    if full.any():
        starts = first[:-1][full]
        for o, salt in zip(out, (0x243F6A8885A308D3, 0x13198A2E03707344)):
            o[full] = np.add.reduceat(mix(flat ^ np.uint64(salt)), starts)
    return out[0], out[1]


def signature(mins: np.ndarray) -> np.ndarray:
    """Two bits of each of the first 30 minhash columns, as one long a row; ``differing`` compares them."""
    out = np.zeros(len(mins), np.uint64)
    for k in range(30):
        out |= (mix(mins[:, k].astype(np.uint64)) & np.uint64(3)) << np.uint64(2 * k)
    return out.view(np.int64)
