"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is rotated by random orthogonal matrices.  The signs after the first
rotation are its binary code; with them the inner product between the code
and the vector itself is stored, the correction factor that makes
``<code, R y> / factor`` an unbiased estimate of ``<x, y>``.  The estimate's error
has a known spread, so a confidence bound tells which pairs can reach the threshold;
only those are recomputed exactly in double precision.

Pairs come from sign-bit tables: runs of ``k`` sign bits are bucket keys, with
k about log2(rows) and as many tables as bring the chance that a pair at the
threshold is never met below ``miss``.  The number of tables grows only as a small power of the
rows (0.15 for cosine 0.95).  A pair is looked at in the first table where it
meets and nowhere else, so links are counted without ever writing pairs.
Equal vectors are one class with a weight.  Large buckets are cut into blocks and each task
compares two blocks.  That is done twice: a screen moves codes, factors and rotated
vectors in bytes only and says which rows have a pair within the bound; the
floats of those rows alone follow, and decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, with_smallest
from .vectors import as_floats, matrix, unit, usable

#: Members of a bucket that one block holds at most, about.
BLOCK = 1024
#: Pairs that are compared at once.
SLICE = 1 << 15
#: The confidence bound in standard deviations of the estimate.
SIGMAS = 5.5


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan_tables(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits of a key, tables) for so many rows."""
    same = 1 - math.acos(cosine) / math.pi
    k = min(30, max(8, math.ceil(math.log2(max(rows, 2)))))
    return k, math.ceil(math.log(miss) / math.log1p(-(same**k)))


def _encoder(k: int, tables: int, seed: int):
    def run(batches):
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = unit(matrix(part.column(1), dim))
                turned = [x @ rotation(dim, seed + j).T for j in range(-(-tables * k // dim))]
                bits = np.concatenate(turned, axis=1)[:, : tables * k] > 0
                values = (bits.reshape(len(x), tables, k) * (1 << np.arange(k)).astype(np.int32)).sum(2, dtype=np.int32)
                step = np.abs(turned[0]).max(1) / 127
                small = np.rint(turned[0] / step[:, None]).astype(np.int8)
                factor = np.abs(turned[0]).sum(1) / math.sqrt(dim)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.full(len(x), dim, np.int32)), _rows(np.packbits(turned[0] > 0, axis=1)), pa.array(factor), _rows(small), pa.array(step), pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), tables).cast(pa.list_(pa.int32()))],
                    ["rep", "embedding", "w", "dim", "code", "factor", "small", "step", "tables"],
                )

    return run


def _rows(x: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    return pa.array(list(map(bytes, np.ascontiguousarray(x))), pa.binary())


def _bytes(t: pa.Table, name: str, rows: np.ndarray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)


def _runs(batches, process):
    """``process`` applied to tables of whole runs, from batches sorted by run."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 8192:
            continue
        t = pa.Table.from_batches(held)
        runs = t.column("run").to_numpy()
        cut = int(np.searchsorted(runs == runs[-1], True))  # the last run may go on
        if cut:
            yield from process(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield from process(pa.Table.from_batches(held))


def _pairs(run: np.ndarray, cross: np.ndarray, side: np.ndarray):
    """(a, b) of the pairs of rows within runs, SLICE at a time; of two blocks only pairs across."""
    i, d = np.arange(len(run)), 0
    while True:
        d += 1
        i = i[i + d < len(run)]
        i = i[run[i] == run[i + d]]
        if not len(i):
            return
        for lo in range(0, len(i), SLICE):
            a = i[lo : lo + SLICE]
            b = a + d
            ok = ~cross[a] | (side[a] != side[b])
            yield a[ok], b[ok]


def _screen(cosine: float):
    """Batches sorted by run -> (run, rep): the rows of a pair that the codes cannot rule out."""

    def process(t: pa.Table):
        rep, run, cross, side, dims = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "run", "is_cross", "side", "dim"))
        factor, step = t.column("factor").to_numpy(), t.column("step").to_numpy()
        hit = np.zeros(len(rep), bool)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            signs = (np.unpackbits(_bytes(t, "code", rows, np.uint8), axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
            turned = _bytes(t, "small", rows, np.int8).astype(np.float32) * step[rows, None].astype(np.float32)
            f = factor[rows]
            # spread of the estimate for a pair right at the threshold, and the most that rounding to bytes can add
            bound = SIGMAS * np.sqrt((1 - f * f) / (f * f)) / math.sqrt(max(dim - 1, 1)) * math.sqrt(1 - cosine * cosine)
            rounding = step[rows] * math.sqrt(dim) / 2
            found = np.zeros(len(rows), bool)
            for a, b in _pairs(run[rows], cross[rows], side[rows]):
                new = ~(found[a] & found[b])
                a, b = a[new], b[new]
                estimate = np.einsum("ij,ij->i", signs[a], turned[b]) / f[a]
                ok = estimate >= cosine - bound[a] - rounding[b] / f[a] - 1e-5
                found[a[ok]] = found[b[ok]] = True
            hit[rows] = found
        yield pa.RecordBatch.from_arrays([pa.array(run[hit]), pa.array(rep[hit])], ["run", "rep"])

    return lambda batches: _runs(batches, process)


def _linker(cosine: float):
    """Batches sorted by run -> (rep, root, links): what each run of rows adds, by exact cosines."""

    def process(t: pa.Table):
        rep, w, run, cross, side, dims, at = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "w", "run", "is_cross", "side", "dim", "at"))
        col, tables = t.column("embedding").combine_chunks(), t.column("tables").combine_chunks()
        linked = []
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = unit(matrix(col.take(pa.array(rows)), dim))
            values = tables.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
            tb = at[rows]
            for a, b in _pairs(run[rows], cross[rows], side[rows]):
                ok = (values[a] == values[b]).argmax(1) == tb[a]  # met in no earlier table
                a, b = a[ok], b[ok]
                ok = (x[a] * x[b]).sum(1) >= cosine
                if ok.any():
                    linked.append((rows[a[ok]], rows[b[ok]]))
        if not linked:
            return
        a, b = (np.concatenate(z) for z in zip(*linked))
        ids, at = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        ia, ib = at[: len(a)], at[len(a) :]
        links = np.bincount(ia, w[b], len(ids)) + np.bincount(ib, w[a], len(ids))
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[ia], root[ib])
            new = root.copy()
            np.minimum.at(new, ia, low)
            np.minimum.at(new, ib, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(links.astype(np.int64))], ["rep", "root", "links"])

    return lambda batches: _runs(batches, process)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = 1e-4, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links and components of vectors whose cosine is at least ``cosine``.

    Returns one row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept (vec_id =
    component_id).  A link at the threshold is missed with a chance of ``miss`` at most,
    closer ones far less; nothing below the threshold is linked.

    Null vectors, empty or all-zero ones and those with null or non-finite components
    link with nothing.  Vectors of different lengths never link.  Repeated rows
    count as rows of their own in n_links, and rows that share an id with different vectors are
    judged each by its own vector.  Rows with a null id are left out; extra
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), as_floats(vectors, vec_col).alias("embedding")).where("vec_id is not null")
    base = base.withColumn("fine", usable("embedding"))
    base = base.withColumn("d1", F.when(F.col("fine"), F.xxhash64("embedding"))).withColumn("d2", F.when(F.col("fine"), F.xxhash64(F.lit(1), F.col("embedding"))))
    groups = base.where("fine").groupBy("d1", "d2").agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count(F.lit(1)).alias("w"))
    # a class is known by a number of its own: ids may repeat with other vectors
    groups = scratch.save(groups.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", F.col("m.vec_id").alias("vec_id"), "w", "m.embedding"))
    k, tables = plan_tables(groups.count(), cosine, miss)

    kind = groups.schema["embedding"].dataType.simpleString()
    payload = f"rep long, embedding {kind}, w long, dim int, code binary, factor double, small binary, step double, tables array<int>"
    coded = scratch.save(groups.select("rep", "embedding", "w").mapInArrow(_encoder(k, tables, seed), payload))
    placed = coded.select("rep", "dim", F.posexplode("tables").alias("at", "value"))
    met = placed.groupBy("dim", "at", "value").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("dim", "at", "value", F.ceil(F.col("k") / BLOCK).alias("nb"))
    placed = placed.join(met, ["dim", "at", "value"]).withColumn("blk", F.expr("pmod(xxhash64(rep), nb)"))
    placed = placed.withColumn("o", F.explode(F.expr("sequence(0L, nb - 1)")))
    placed = placed.withColumn("b1", F.least("blk", "o")).withColumn("b2", F.greatest("blk", "o"))
    placed = placed.select("rep", "at", F.xxhash64("dim", "at", "value", "b1", "b2").alias("run"), (F.col("b1") != F.col("b2")).alias("is_cross"), F.col("blk").alias("side"))
    placed = scratch.save(placed)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("run").sortWithinPartitions("run", "rep")

    # every class is in every table: both sides are dealt out at any size
    codes = placed.hint("merge").join(coded.select("rep", "dim", "code", "factor", "small", "step"), "rep").drop("at")
    hits = scratch.save(dealt(codes).mapInArrow(_screen(cosine), "run long, rep long"))
    exact = placed.join(hits, ["run", "rep"], "left_semi").join(coded.select("rep", "w", "dim", "embedding", "tables"), "rep")
    found = scratch.save(dealt(exact).mapInArrow(_linker(cosine), "rep long, root long, links long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(scratch, found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))

    named = with_smallest(scratch, groups.select("rep", "d1", "d2", "vec_id", "w"), comp, "vec_id").join(links, "rep", "left")
    named = named.select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = base.select("vec_id", "d1", "d2").join(named, ["d1", "d2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.col("vec_id") == F.col("component_id")))
    scratch.drop(groups, coded, placed, hits, found, comp)
    return out
