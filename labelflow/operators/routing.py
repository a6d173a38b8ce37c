"""Routing rows to instances: key groups, lanes, compartments, weights, drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import Lattice


def canonical(*cols: tuple[str, Column]) -> Column:
    """An injective binary encoding of a key: per part a type tag (s, i, f, b), its length and its text."""
    out = []
    for tag, c in cols:
        text = F.encode(c.cast("string"), "UTF-8")
        n = F.octet_length(text)
        size = [F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]  # little end first
        out.append(F.unhex(F.concat(F.hex(F.encode(F.lit(tag), "UTF-8")), *size, F.hex(text))))
    return F.concat(*out)


# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def hash_rows(data: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of the rows of a byte matrix, all rows at once."""
    rows, n = data.shape
    lane = lambda at, width: np.ascontiguousarray(data[:, at : at + width]).view(f"<u{width}").astype(np.uint64)[:, 0]
    turn = lambda acc, x: _rotl(acc + x * _P2, 31) * _P1
    zero, at = np.zeros(rows, np.uint64), 0
    if n >= 32:
        acc = [zero + _P1 + _P2, zero + _P2, zero, zero - _P1]
        while at + 32 <= n:
            acc = [turn(a, lane(at + 8 * k, 8)) for k, a in enumerate(acc)]
            at += 32
        h = sum((_rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18))), zero)
        for a in acc:
            h = (h ^ turn(zero, a)) * _P1 + _P4
    else:
        h = zero + _P5
    h = h + np.uint64(n)
    for width, mul, rot, by, add in ((8, None, 27, _P1, _P4), (4, _P1, 23, _P2, _P3), (1, _P5, 11, _P1, np.uint64(0))):
        while at + width <= n:
            x = lane(at, width)
            h = _rotl(h ^ (turn(zero, x) if mul is None else x * mul), rot) * by + add
            at += width
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


@F.arrow_udf(T.LongType())
def xxh64(data: pa.Array) -> pa.Array:
    """XXH64 with seed 0 as a signed long; Spark's own xxhash64 has another seed and encoding."""
    data = data.cast(pa.binary())
    out, size = np.zeros(len(data), np.int64), data.fill_null(b"").cast(pa.binary())
    at = np.frombuffer(size.buffers()[1], np.int32)[size.offset : size.offset + len(size) + 1]
    flat = np.frombuffer(size.buffers()[2], np.uint8) if size.buffers()[2] is not None else np.zeros(0, np.uint8)
    for n in np.unique(np.diff(at)).tolist():
        rows = np.flatnonzero(np.diff(at) == n)
        out[rows] = hash_rows(flat[at[rows][:, None] + np.arange(n)]).view(np.int64)
    return pa.array(out, mask=~np.asarray(data.is_valid().to_numpy(zero_copy_only=False), bool))


def key_group(encoded: Column, groups: int = 128) -> Column:
    """The group of an encoded key: its unsigned hash modulo ``groups``, a power of two."""
    if groups & (groups - 1):
        raise ValueError("groups must be a power of two")
    return xxh64(encoded).bitwiseAND(F.lit(groups - 1)).cast("int")


def instance_of(group: Column, instances: int, groups: int = 128) -> Column:
    return F.floor(group.cast("long") * instances / groups).cast("int")


def owned_ranges(spark: SparkSession, instances: int, groups: int = 128) -> DataFrame:
    """(instance, group_from, group_to): the groups each instance owns, group_to not included."""
    i = F.col("id")
    up = lambda x: F.floor((x * groups + instances - 1) / instances).cast("int")
    return spark.range(instances).select(i.cast("int").alias("instance"), up(i).alias("group_from"), up(i + 1).alias("group_to"))


def lanes(labels: DataFrame, lattice: Lattice, tops: list[str], name: str = "label") -> DataFrame:
    """``labels`` with the lane that takes them: the lowest of ``tops`` at or above the label, else null."""
    ordered = [x for x in lattice.order() if x in tops]
    lane = F.coalesce(*[F.when(lattice.col_leq(F.col(name), F.lit(t)), F.lit(t)) for t in ordered])
    return labels.withColumn("lane", lane)


def compartment_groups(df: DataFrame, lattice: Lattice, group: Column, name: str = "_label") -> DataFrame:
    """``df`` with route: its key group within the lane of its label's compartment (null for a label of none), so compartments never share an instance."""
    lane = F.element_at(lattice.as_map(lattice.compartment), F.col(name))
    return df.withColumn("route", F.when(lane.isNotNull(), F.concat_ws("/", lane.cast("string"), group.cast("string"))))


def queued(df: DataFrame, waiting: DataFrame | None, lattice: Lattice, ceilings: list[str], name: str = "_label") -> tuple[DataFrame, DataFrame]:
    """(rows that some receiver may have, rows that wait for one): new rows together with those that ``waiting`` held so far."""
    rows = df if waiting is None else waiting.unionByName(df)
    free = F.lit(False)
    for c in ceilings:
        free = free | F.coalesce(lattice.col_leq(F.col(name), F.lit(c)), F.lit(False))
    return rows.where(free), rows.where(~free)


def broadcast_copies(df: DataFrame, lattice: Lattice, receivers: list[tuple[str, str]], name: str = "_label") -> DataFrame:
    """A copy of each row for each receiver (name, ceiling) that may have it; the receivers are a literal list."""
    all_of = F.array(*[F.struct(F.lit(r).alias("receiver"), F.lit(c).alias("ceiling")) for r, c in receivers])
    fit = F.filter(all_of, lambda r: lattice.col_leq(F.col(name), r["ceiling"]))
    return df.withColumn("_r", F.explode(fit)).withColumn("receiver", F.col("_r.receiver")).drop("_r")


def drift(observed: DataFrame, expected: DataFrame, edge: str = "edge", label: str = "label", least: int = 200, limit: float = 0.2) -> DataFrame:
    """(edge, n, distance, drifted): total-variation distance of observed labels from the (edge, label, p) expected."""
    got = observed.groupBy(edge, label).agg(F.count(F.lit(1)).alias("n"))
    sums = got.groupBy(edge).agg(F.sum("n").alias("total"))
    both = got.join(sums, edge).select(edge, label, (F.col("n") / F.col("total")).alias("q")).join(expected.select(edge, label, "p"), [edge, label], "full")
    out = both.groupBy(edge).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance")).join(sums, edge, "left")
    n = F.coalesce("total", F.lit(0))
    return out.select(edge, n.alias("n"), "distance", ((n >= least) & (F.col("distance") > limit)).alias("drifted"))


def weighted_pick(df: DataFrame, table: DataFrame, u: Column, label: str = "label") -> DataFrame:
    """``df`` with the receiver that each row's number ``u`` in [0, 1) picks among its label's weights.

    table: (label, receiver, weight), some rows a label; receivers are taken in the order of their names, weights scaled to 1.
    Rows of a label without a receiver stay, with a null receiver, to be routed once there is one.
    """
    order = Window.partitionBy(label).orderBy("receiver")
    t = table.where("weight > 0").withColumn("hi", F.sum("weight").over(order) / F.sum("weight").over(Window.partitionBy(label)))
    ranges = t.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("hi", "receiver"))).alias("_r"))
    d = df.withColumn("_u", u).join(ranges, label, "left")
    hit = F.filter("_r", lambda r: r["hi"] > F.col("_u"))
    return d.withColumn("receiver", F.coalesce(F.get(hit, 0), F.element_at("_r", -1))["receiver"]).drop("_u", "_r")
