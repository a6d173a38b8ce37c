"""Embedding whitening by a tiled covariance.

1. Vectors become whole numbers (fixed point), so their number and sums are exact.
2. Rows are taken in blocks, and a block's columns in column blocks of TILE dimensions.  Column blocks are shuffled by
   row block and paired there into tiles: a tile key is a pair of column blocks.
3. Each pair is centred exactly and multiplied; products are summed per tile, within tasks first.
4. The tiles are assembled to the covariance, as large as the square of the dimension and no larger with more
   rows, and decomposed; rows are projected where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import as_floats

#: Dimensions of a column block, rows of a row block, and bytes of partial tiles that a task holds.
TILE, BLOCK_ROWS, HELD = 32, 4096, 64 << 20
#: Components whose eigenvalue is below this share of the largest, times the dimension, have no direction in double precision.
RANK = 1e-13
#: Fixed-point numbers stay below this, so that they and their differences are exact in long and double.
LARGEST = 1 << 52


def _finite(name: str, most: float):
    """True for vectors without null or non-finite components whose fixed-point numbers are exact."""
    fine = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most))
    return F.coalesce(fine, F.lit(False))


def _numbers(column, dim: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of the components, a row per vector."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(v * scale).astype(np.int64) + offset


def _sums(dim: int, scale: int, offset: int):
    """Batches of vectors -> (d, hi, lo): the sum of a task's numbers in each dimension is hi * 2**32 + lo."""

    def run(batches):
        hi, lo = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _numbers(batch.column(0), dim, scale, offset)
            hi += (x >> 32).sum(0)
            lo += (x & 0xFFFFFFFF).sum(0)
            hi, lo = hi + (lo >> 32), lo & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(hi), pa.array(lo)], ["d", "hi", "lo"])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the fewest bytes that hold it."""
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def _column_blocks(dim: int, tile: int, scale: int, offset: int, centre: np.ndarray):
    """Batches of vectors -> (rb, cb, width, data): numbers less ``centre``, a whole number near the mean, so they are short."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                x = _numbers(batch.column(0).slice(lo, BLOCK_ROWS), dim, scale, offset) - centre
                rb = (part << 32) + k
                k += 1
                parts = [_narrow(x[:, c : c + tile]) for c in range(0, dim, tile)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rb] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([p.itemsize for p in parts], pa.int32()), pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())],
                    ["rb", "cb", "width", "data"])

    return run


_WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _products(dim: int, tile: int, rest: np.ndarray, n: int):
    """Pairs of column blocks -> (i, j, data): sums of their products, centred first; rest: n * centre less the sums, exact."""

    def block(data: bytes, width: int, c: int) -> np.ndarray:
        m = min(tile, dim - c * tile)
        x = np.frombuffer(data, _WIDTHS[width]).reshape(-1, m).astype(np.float64)
        return x + rest[c * tile : c * tile + m] / n

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["i", "j", "data"])

        for batch in batches:
            for i, j, wi, wj, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "wi", "wj", "a", "b"))):
                x = block(a, wi, i)
                p = x.T @ (x if i == j else block(b, wj, j))
                held[i, j] = held[i, j] + p if (i, j) in held else p
                if len(held) * tile * tile * 8 > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _tile_sums(batches):
    """(i, j, data) sorted by tile -> one row per tile, the sum of its matrices."""
    key = total = None
    for batch in batches:
        for i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
            m = np.frombuffer(data, np.float64)
            if (i, j) != key:
                if key is not None:
                    yield _tile_row(key, total)
                key, total = (i, j), np.zeros(len(m))
            total = total + m
    if key is not None:
        yield _tile_row(key, total)


def _tile_row(key, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "data"])


TILES = "i int, j int, data binary"


def _summed(tiles: DataFrame, salts: int) -> DataFrame:
    """One row per tile: partial tiles are summed in ``salts`` parts each, then those."""
    salted = tiles.withColumn("salt", F.spark_partition_id() % salts).repartition("i", "j", "salt").sortWithinPartitions("i", "j", "salt").select("i", "j", "data")
    return salted.mapInArrow(_tile_sums, TILES).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_tile_sums, TILES)


@dataclass
class Whitening:
    """A fitted whitening: n vectors of ``dim`` components, their exact ``sums`` in fixed point, and the components.

    components has a column per component, eigenvalues and explained (share of the whole variance) a value;
    covariance is that of the fixed-point numbers.
    """

    n: int
    dim: int
    scale: int
    offset: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def _centred(self):
        """Vectors -> (n * x - sums exactly, in pairs whole and rest modulo n; x less the mean in double)."""
        n, dim, scale, offset = self.n, self.dim, self.scale, self.offset
        centre = np.array([s // n for s in self.sums], np.int64)
        rest = np.array([s % n for s in self.sums], np.int64)

        def run(column):
            y = _numbers(column, dim, scale, offset) - centre  # n * x - sums = n * y - rest
            return y, rest, y - rest / n

        return run

    def transform(self, df: DataFrame, vector: str = "embedding", whitened: str = "whitened", deviation: str | None = None) -> DataFrame:
        """``df`` with the whitened vector, null where the vector takes no part; other columns pass through.

        deviation: the name of a further column, the exact sum over dimensions of (n * x - sums) ** 2; null if it
        does not fit a long.
        """
        n, centred, w = self.n, self._centred(), self.components / np.sqrt(self.eigenvalues)
        names = [f"c{k}" for k in range(len(df.columns))]
        schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, df.schema.fields))

        def run(batches):
            for batch in batches:
                v, ok = batch.column(len(names)), batch.column(len(names)).is_valid()
                y, rest, d = centred(v.filter(ok))
                at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
                out = np.full(batch.num_rows, -1)
                out[at] = np.arange(len(at))
                back = pa.array(out, mask=out < 0)
                z = d @ w
                lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), max(1, w.shape[1])).cast(pa.list_(pa.float64())) if w.shape[1] else pa.array([[]] * len(at), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], lists.take(back), _squares(y, rest, n).take(back)], [*names, "z", "q"])

        usable = F.when(_usable(vector, self.dim, self.scale, self.offset), as_floats(df, vector))
        src = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(df.columns, names)], usable.alias("v"))
        out = src.mapInArrow(run, f"{schema}, z array<double>, q long")
        more = [F.col("q").alias(deviation)] if deviation else []
        return out.select(*[F.col(k).alias(c) for c, k in zip(df.columns, names)], F.col("z").alias(whitened), *more)

    def identity_error(self, df: DataFrame, vector: str = "embedding") -> float:
        """The largest absolute entry of the whitened vectors' covariance, measured over ``df``, minus the identity."""
        k, n = self.components.shape[1], self.n
        centred, w = self._centred(), self.components / np.sqrt(self.eigenvalues)

        def run(batches):
            gram, total = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                z = centred(batch.column(0))[2] @ w
                gram += z.T @ z
                total += z.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([np.append(gram, total).tobytes()], pa.binary())], ["i", "j", "data"])

        if not k:
            return 0.0
        tiles = _vectors(df, vector, self.dim, self.scale, self.offset).mapInArrow(run, TILES)
        both = np.frombuffer(_summed(tiles, _salts(df)).first()["data"])
        gram, mean = both[: k * k].reshape(k, k) / n, both[k * k :] / n
        return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())  # centred before; the mean is what rounding has left


def _squares(y: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """sum((n * y - rest) ** 2) of each row, exactly; null beyond a long."""
    top = (int(np.abs(y).max()) if y.size else 0) * n + n
    if top * top * max(1, y.shape[1]) < 1 << 63:
        return pa.array(((n * y - rest) ** 2).sum(1))
    exact = ((y.astype(object) * n - rest.astype(object)) ** 2).sum(1)
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _usable(vector: str, dim: int, scale: int, offset: int):
    return (F.size(vector) == dim) & _finite(vector, (LARGEST - abs(offset)) // scale)


def _vectors(df: DataFrame, vector: str, dim: int, scale: int, offset: int) -> DataFrame:
    return df.where(_usable(vector, dim, scale, offset)).select(as_floats(df, vector).alias("v"))


def _salts(df: DataFrame) -> int:
    return max(1, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000, tile: int = TILE) -> Whitening | None:
    """Fit on all vectors of ``df``: a component c counts as floor(scale * c) + offset.

    Vectors that are null or empty, or hold nulls, non-finite components or ones beyond 2 ** 52 in fixed point, take no part.  A covariance
    needs one dimension: where lengths differ, vectors of the commonest length (of ties, the longest) are fitted
    and the others take no part.  Up to ``components`` components are numbered by falling eigenvalue; their signs are such
    that the largest entry is positive.  Directions without variance have no whitening and are left out: equal vectors, or
    one alone, have no components.  Repeated rows count as often as they occur.  Without vectors the result is None.
    """
    scratch = Scratch(df.sparkSession)
    lengths = df.where(F.size(vector) > 0).where(_finite(vector, (LARGEST - abs(offset)) // scale)).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim, n = lengths["dim"], lengths["count"]
    v = _vectors(df, vector, dim, scale, offset)
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = v.mapInArrow(_sums(dim, scale, offset), "d long, hi long, lo long").groupBy("d").agg(wide("hi").alias("hi"), wide("lo").alias("lo")).collect()
    sums = [0] * dim
    for r in found:  # a row per dimension
        sums[r["d"]] = int(r["hi"]) * (1 << 32) + int(r["lo"])
    centre = [s // n for s in sums]
    rest = np.array([n * c - s for c, s in zip(centre, sums)], np.float64)

    blocks = scratch.save(v.mapInArrow(_column_blocks(dim, tile, scale, offset, np.array(centre, np.int64)), "rb long, cb int, width int, data binary"))
    left = blocks.select("rb", F.col("cb").alias("i"), F.col("width").alias("wi"), F.col("data").alias("a"))
    right = blocks.select("rb", F.col("cb").alias("j"), F.col("width").alias("wj"), F.col("data").alias("b"))
    pairs = left.hint("merge").join(right, "rb").where("i <= j").select("i", "j", "wi", "wj", "a", "b")
    tiles = _summed(pairs.mapInArrow(_products(dim, tile, rest, n), TILES), _salts(df))
    cov = np.zeros((dim, dim))
    for r in tiles.collect():  # the square of the dimension in all
        i, j = r["i"] * tile, r["j"] * tile
        a, b = min(tile, dim - i), min(tile, dim - j)
        m = np.frombuffer(r["data"]).reshape(a, b) / n
        cov[i : i + a, j : j + b] = m
        cov[j : j + b, i : i + a] = m.T
    scratch.drop(blocks)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = np.flatnonzero(e > max(e.max(initial=0.0), 0.0) * dim * RANK)[:components]
    e, u, whole = e[keep], u[:, keep], float(np.trace(cov))
    if len(keep):
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(len(keep))])
    return Whitening(n, dim, scale, offset, sums, cov, e, u, e / whole if whole else e)


def whiten(df: DataFrame, vector: str = "embedding", components: int = 32, **options) -> tuple[DataFrame, Whitening | None]:
    """(``df`` with whitened, the fitted whitening); with no vector to fit, whitened is null throughout."""
    model = fit(df, vector, components, **options)
    return (df.withColumn("whitened", F.lit(None).cast("array<double>")) if model is None else model.transform(df, vector)), model
