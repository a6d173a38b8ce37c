"""Nearest neighbours by inner product through multi-index hashing.

Vectors of any norm are lifted by one coordinate so that the largest inner product
becomes the smallest angle.  Rotations learned on a bounded sample (principal axes
turned to lose least by taking signs) give binary codes.  A code is cut into
substrings, and each shard of the rows keeps an index from substring
values to rows.  By the pigeonhole principle a code within Hamming radius t * m + i of the query
agrees with it within t bits on one of the first i + 1 of m substrings or within t - 1
bits on one of the others, so probing those buckets, and nothing else, retrieves every code within that radius.
What is retrieved and within the radius is reranked on floats.

The radius grows bucket by bucket.  The k-th best inner product so far is an
angle, and a code at that angle differs in so many bits on average;
``slack`` more bits, learned on the sample, hold ``recall`` of its true
neighbours.  Probing ends once the radius reaches that number, which falls as better neighbours turn up:
near neighbours end it after few buckets, and rows without near ones need many.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import as_floats, matrix, norms, unit, usable

#: Rows that the rotations and the slack are learned from, at most (about).
SAMPLE_ROWS = 8192
#: Rows of a shard and queries of a block, about; a task holds one of each.
SHARD_ROWS, QUERY_ROWS = 65536, 512
#: Bits of a substring, and the numbers that differ from 0 in 0, 1, ... of them.
SUB = 16
BALLS = [np.flatnonzero(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)) == t) for t in range(SUB + 1)]
#: A length of vectors with fewer rows in the sample gets random rotations, not learned ones.
LEAST_ROWS = 256
#: Slack in standard deviations of the bits that differ, at least and where none was learned.
LEAST_SLACK, WIDE = 1.2, 3.0


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 25) -> np.ndarray:
    """dim x bits: principal axes, turned so that signs lose least (iterative quantisation)."""
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :bits]
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))
    for _ in range(rounds):
        b = np.where(v @ r > 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(b.T @ v)
        r = (u @ wt).T
    return axes @ r


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Unit rows whose angle to a (query, 0) falls as the inner product grows; no row is longer than ``top``."""
    x = x / top
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], axis=1)


def encode(x: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """Codes as substrings, a row each; the last is filled up with zeros."""
    bits = np.concatenate([x @ t > 0 for t in turns], axis=1)
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUB))), axis=1).view(np.uint16)


def encode_queries(q: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    return encode(np.concatenate([unit(q), np.zeros((len(q), 1))], axis=1), turns)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int32)


class Coder:
    """Rotations of vectors of one length and the slack of their codes in bits."""

    def __init__(self, turns: list[np.ndarray], slack: float = 0.0, least: float = 0.0):
        self.turns, self.slack, self.least = turns, slack, least
        self.bits = sum(t.shape[1] for t in turns)

    def radius(self, score: float, length: float) -> float:
        """The Hamming radius for what scores at least ``score``, ``length`` being the product of the lengths."""
        p = math.acos(min(1.0, max(-1.0, score / length))) / math.pi
        return self.bits * p + max(self.slack, self.least * math.sqrt(self.bits * p * (1 - p)))


def _width(dim: int) -> int:
    return min(64, -(-(dim + 1) // 8) * 8)


def random_coder(dim: int, n_bits: int, seed: int) -> Coder:
    """Rotations drawn at random, for lengths that too few rows of the sample have."""
    rng, width = np.random.default_rng([seed, dim]), _width(dim)
    turns = [rng.standard_normal((dim + 1, width)) for _ in range(max(1, n_bits // width))]
    return Coder(turns, least=WIDE)


def fit(sample: np.ndarray, n_bits: int, k: int, recall: float, seed: int) -> Coder:
    """A coder from a bounded sample of rows, all of one length."""
    top = norms(sample).max()
    lifted, width = lift(sample, top), _width(sample.shape[1])
    if lifted.shape[1] < width:
        lifted = np.pad(lifted, ((0, 0), (0, width - lifted.shape[1])))
    coder = Coder([learn_rotation(lifted, width, seed + j)[: sample.shape[1] + 1] for j in range(max(1, n_bits // width))])
    codes = encode(lifted[:, : sample.shape[1] + 1], coder.turns)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    qcodes, lengths, over = encode_queries(sample[asked], coder.turns), norms(sample[asked]) * top, []
    for j, q in enumerate(asked):
        s = sample @ sample[q]
        s[q] = -np.inf
        best = np.argsort(-s)[: min(k, len(sample) - 1)]
        over.append(hamming(codes[best], qcodes[j]) - coder.radius(s[best[-1]], lengths[j]))
    coder.slack, coder.least = float(np.quantile(np.concatenate(over), recall)), LEAST_SLACK
    return coder


class SubstringIndex:
    """For each substring, the rows of each value: its buckets."""

    def __init__(self, codes: np.ndarray):
        self.m = codes.shape[1]
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -self.m % 4))).view(np.uint64).T)
        self.order = [np.argsort(codes[:, i], kind="stable").astype(np.int32) for i in range(self.m)]
        self.first = [np.searchsorted(codes[self.order[i], i], np.arange((1 << SUB) + 1)).astype(np.int32) for i in range(self.m)]
        self.occupied = [np.flatnonzero(np.diff(f)).astype(np.uint16) for f in self.first]

    def _buckets(self, i: int, value: int):
        """For t = 0, 1, ...: the values of buckets at distance t.  All values at the distance are tried as long as they are
        few next to the occupied buckets; then the occupied ones are put in order of their distance."""
        t = 0
        while t <= SUB and 16 * len(BALLS[t]) < len(self.occupied[i]):
            yield BALLS[t] ^ value
            t += 1
        apart = np.bitwise_count(self.occupied[i] ^ np.uint16(value))
        by = np.argsort(apart, kind="stable")
        cut = np.searchsorted(apart[by], np.arange(t, SUB + 2))
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield self.occupied[i][by[lo:hi]].astype(np.int64)

    def probe(self, code: np.ndarray):
        """(radius, listed rows, their distances): all codes within a radius have come by the time it is yielded; rows come again."""
        word = np.pad(code, (0, -self.m % 4)).view(np.uint64)
        buckets = [self._buckets(i, int(code[i])) for i in range(self.m)]
        for t in range(SUB + 1):
            for i in range(self.m):
                first, values = self.first[i], next(buckets[i])
                lo = first[values]
                size = first[values + 1] - lo
                ends = np.cumsum(size)
                rows = self.order[i][np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                apart = np.zeros(len(rows), np.uint8)
                for words, w in zip(self.words, word):
                    apart += np.bitwise_count(words[rows] ^ w)
                yield t * self.m + i, rows, apart

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows of every code within ``radius``."""
        out = []
        for r, rows, apart in self.probe(code):
            out.append(rows[apart <= radius])
            if r >= radius:
                break
        return np.unique(np.concatenate(out))


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, coder: Coder, k: int) -> tuple[list, np.ndarray]:
    """([(rows, scores) of each query's best], entries that the probed buckets listed for each query)."""
    top = norms(x).max()
    index, qcodes, qnorm = SubstringIndex(encode(lift(x, top), coder.turns)), encode_queries(q, coder.turns), norms(q)
    out, listed = [], np.zeros(len(q), np.int64)
    for j in range(len(q)):
        rows, scores, limit = np.zeros(0, np.int32), np.zeros(0), 255.0
        seen = ids == qids[j]
        for r, new, apart in index.probe(qcodes[j]):
            listed[j] += len(new)
            new = new[apart <= limit]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                rows, scores = np.append(rows, new), np.append(scores, x[new] @ q[j])
                if len(rows) >= k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    limit = min(limit, coder.radius(least, qnorm[j] * top))
                    keep = scores >= least - 1e-9 * abs(least)  # what rounding may still reorder
                    rows, scores = rows[keep], scores[keep]
            if r >= limit:
                break
        scores = (x[rows] * q[j]).sum(1)
        best = np.lexsort((ids[rows], -scores))[:k]
        out.append((rows[best], scores[best]))
    return out, listed


def _searcher(coders: dict[int, Coder], n_bits: int, k: int, seed: int):
    def run(data: pa.Table, queries: pa.Table):
        parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        sides = [(t.column("vec_id").to_numpy(), t.column("embedding").combine_chunks()) for t in (data, queries)]
        dims = [c.value_lengths().to_numpy(zero_copy_only=False) for _, c in sides]
        for dim in np.intersect1d(*dims).tolist() if data.num_rows and queries.num_rows else ():
            (ids, x), (qids, q) = (((i := np.flatnonzero(d == dim)), (v[i], matrix(c.take(pa.array(i)), dim)))[1] for (v, c), d in zip(sides, dims))
            coder = coders.get(dim) or random_coder(dim, n_bits, seed)
            found, _ = search(x, ids, q, qids, coder, k)
            parts += [(np.full(len(rows), qids[j]), ids[rows], scores) for j, (rows, scores) in enumerate(found)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(z) for z in zip(*parts)))))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, n_bits: int = 128, recall: float = 0.96, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score (the inner product of the
    original vectors in double precision); nearest first, ties to the smaller vec_id,
    a query's own id left out.  A query with fewer candidates gets them all.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with
    a null id, take no part.  A query's candidates are the vectors of its own length, whichever that is.
    Repeated rows are candidates of their own.  Extra columns are ignored.  Without usable vectors
    the result is empty.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), as_floats(df, vec_col).alias("embedding"))
        return df.where(F.col("vec_id").isNotNull() & usable("embedding"))

    data, asked = clean(vectors), clean(queries)
    n = data.count()
    share = min(1 << 20, SAMPLE_ROWS * (1 << 20) // max(n, 1) + 1)
    picked = data.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()
    column = picked.column(0).combine_chunks()
    dims = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    coders = {}
    for dim, rows in zip(*np.unique(dims, return_counts=True)):
        if rows >= LEAST_ROWS:
            coders[int(dim)] = fit(matrix(column.take(pa.array(np.flatnonzero(dims == dim))), int(dim)), n_bits, k, recall, seed)

    # a stated query set against all rows in blocks; building a shard's index anew for a block costs a few queries' time
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked.count() / QUERY_ROWS))
    both = F.expr(f"sequence(0, {blocks - 1})"), F.expr(f"sequence(0, {shards - 1})")
    left = data.select("vec_id", "embedding", F.expr(f"int(pmod(xxhash64(vec_id, embedding), {shards}))").alias("shard"), F.explode(both[0]).alias("block"))
    right = asked.select("vec_id", "embedding", F.explode(both[1]).alias("shard"), F.expr(f"int(pmod(xxhash64(vec_id, embedding, 1), {blocks}))").alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_searcher(coders, n_bits, k, seed), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
