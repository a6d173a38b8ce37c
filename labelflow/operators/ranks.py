"""Exact order statistics of many ranges of a column at once, for windows that slide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on together, about; a group is never cut.
CHUNK = 1 << 17


def kth_smallest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The value of rank k, from 0, among values[lo:hi], for all questions together; 0 <= k < hi - lo.

    A wavelet matrix: the values' ranks bit by bit from the top, stably parted at each bit, with the
    number of zeros before each place.  A question moves its range down one bit at a time, so n values and q
    questions cost (n + q) * log n whatever the lengths of the ranges; one bit's level is held at a time.
    """
    kind = np.int32 if len(values) < 1 << 31 else np.int64
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    rank = np.empty(len(values), kind)
    rank[order] = np.arange(len(values), dtype=kind)
    del order
    lo, hi, k, found = lo.astype(kind), hi.astype(kind), k.astype(kind), np.zeros(len(k), kind)
    for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.zeros(len(values) + 1, kind)
        np.cumsum(~one, out=zeros[1:])
        a, b = zeros[lo], zeros[hi]
        down = k < b - a
        found |= np.where(down, kind(0), kind(1 << bit))
        lo, hi, k = np.where(down, a, zeros[-1] + lo - a), np.where(down, b, zeros[-1] + hi - b), np.where(down, k, k - (b - a))
        rank = np.concatenate([rank[~one], rank[one]])
    return ordered[found]


def medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Medians of values[lo:hi], the mean of the middle two of an even number; NaN for an empty range."""
    out, some = np.full(len(lo), np.nan), hi > lo
    lo, hi = lo[some], hi[some]
    n = hi - lo
    both = kth_smallest(values, np.concatenate([lo, lo]), np.concatenate([hi, hi]), np.concatenate([(n - 1) // 2, n // 2]))
    out[some] = (both[: len(n)] + both[len(n) :]) / 2
    return out


def _changes(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns; the first one does."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for name in names:
        codes = t.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of each row's group): whole groups of batches sorted by ``names``, about CHUNK rows at a time.

    Each batch is compared with the last row before it only, so a group of any length costs its rows once.
    """
    held: list[pa.RecordBatch] = []
    size = start = 0  # start: where the last group begins, which may go on

    def numbered(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.cumsum(_changes(t, names)) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]).combine_chunks()
        new = np.flatnonzero(_changes(seam, names)[bool(held) :])
        start = size + int(new[-1]) if len(new) else start
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK and start:
            first = start - (size - batch.num_rows)  # the cut lies in the last batch that has a change
            k = len(held) - 1
            while first < 0:
                k -= 1
                first += held[k].num_rows
            yield numbered([*held[:k], *([held[k].slice(0, first)] if first else [])])
            held, size, start = [held[k].slice(first), *held[k + 1 :]], size - start, 0
    if held:
        yield numbered(held)


def by_groups(df: DataFrame, names: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` applied to whole groups of ``df`` by ``names``, sorted by ``order`` within, many groups at a time."""

    def run(batches):
        for t, group in whole_groups(batches, names):
            yield from work(t, group).to_batches()

    return df.repartition(*[F.col(n) for n in names]).sortWithinPartitions(*names, *order).mapInArrow(run, schema)
