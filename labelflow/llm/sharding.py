"""Sharding by sampled splitters: shards of nearly equal bytes, a native plan of DataFrame operations.

1. Records are keyed by a hash of their text, then one of their id, then their place in the input, so that equal
   texts follow one another and any group can still be cut.
2. A sample weighted half by bytes and half by rows gives splitters: its quantiles.  They cut the keys into ranges that a
   task can order.  Ranges that turn out overfull are subdivided at equal steps of the key.
3. Exact totals of the ranges and running sums within them place every record in one order of bytes.
4. The order is cut at equal numbers of bytes.  A cut that falls into a group of equal texts moves to the nearer edge of
   the group, unless the group is larger than one in TOLERANCE of a shard: then the group is divided there.

Only keys and sizes are shuffled, texts where a caller asks for whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Ranges for each shard at least, rows of a range at most on average, and sampled rows for each range.
RANGES, RANGE_ROWS, SAMPLES = 32, 1_000_000, 8
#: Times the mean rows or bytes of a range from which it is subdivided.
OVERFULL = 2
#: A group of equal texts above one in so many of a shard may be divided among shards.
TOLERANCE = 50
#: Bits of a key, and of the cells by which records find their range.
KEY_BITS, CELL_BITS = 60, 12


def key_of(text: Column) -> Column:
    """60 bits of the MD5 of a text, as a number; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key_of(text).alias("h"), key_of(F.col(f"`{id_col}`")).alias("g"), F.monotonically_increasing_id().alias("r"), *rest)


KEY = ("h", "g", "r")


def _splitters(rows: DataFrame, ranges: int, total: int, count: int, seed: int) -> DataFrame:
    """(key): every SAMPLES-th key of a sample of about SAMPLES * ranges rows, in order.

    A row is taken with a chance that grows with its bytes, so the draw needs one pass and no order.
    """
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 40)) / (1 << 40)
    chance = SAMPLES * ranges * (F.col("size") / total + 1 / count) / 2
    drawn = rows.where(u < chance).select(F.struct(*KEY).alias("key"))
    return drawn.withColumn("k", F.row_number().over(Window.orderBy("key"))).where(f"k % {SAMPLES} = 0").select("key")


def _cells(splitters: DataFrame) -> DataFrame:
    """(cell, below, within): for each cell of first key parts, the splitters before it and those in it."""
    at = splitters.groupBy(F.shiftright("key.h", KEY_BITS - CELL_BITS).alias("cell")).agg(F.array_sort(F.collect_list("key")).alias("within"))
    every = splitters.sparkSession.range(1 << CELL_BITS).withColumnRenamed("id", "cell").join(at, "cell", "left")
    size = F.when(F.col("within").isNull(), 0).otherwise(F.size("within"))
    return every.withColumn("below", F.sum(size).over(Window.orderBy("cell")) - size)


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with range: how many splitters are not above the row's key."""
    key = F.struct(*KEY)
    cells = F.broadcast(_cells(splitters))  # 2 ** CELL_BITS rows; with the splitters in them a few MB at most
    out = rows.withColumn("cell", F.shiftright("h", KEY_BITS - CELL_BITS)).join(cells, "cell")
    inside = F.when(F.col("within").isNull(), 0).otherwise(F.size(F.filter("within", lambda s: s <= key)))
    return out.withColumn("range", (F.col("below") + inside).cast("long")).drop("cell", "below", "within")


def _step(value: str) -> Column:
    """The part, of ``parts`` equal steps from the least to the greatest value in the range, that a value lies in."""
    return F.floor((F.col(value) - F.col(f"{value}_lo")).cast("double") / (F.col(f"{value}_hi") - F.col(f"{value}_lo") + 1).cast("double") * F.col("parts")).cast("long")


def _subdivided(ranged: DataFrame, ranges: int, total: int, count: int) -> DataFrame:
    """``ranged`` (a written table) with sub: overfull ranges are cut by the first key part that differs in them."""
    ends = [f(c).alias(f"{c}_{n}") for c in KEY for n, f in (("lo", F.min), ("hi", F.max))]
    seen = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), *ends)
    share = F.greatest(F.col("n") * ranges / count, F.col("b") * ranges / total)
    seen = seen.withColumn("parts", F.when(share > OVERFULL, F.ceil(share)).otherwise(1)).drop("n", "b")
    sub = F.when(F.col("parts") == 1, 0).when(F.col("h_lo") < F.col("h_hi"), _step("h")).when(F.col("g_lo") < F.col("g_hi"), _step("g")).otherwise(_step("r"))
    out = ranged.join(F.broadcast(seen), "range")  # a row per range
    return out.withColumn("sub", F.least(sub, F.col("parts") - 1).cast("long")).select(*ranged.columns, "sub")


def shard_records(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``; with ``whole`` also row, a struct of all its columns.

    size is the text's UTF-8 bytes plus 1.  Shards differ in bytes by a record at each end and, where a group of equal texts stays
    together, by half a group of one in TOLERANCE of a shard.  Slots number a shard's records from 0 in the order of the keys.
    The sample decides what tasks do, not the result: it depends on ids and texts alone.

    Null texts count as empty and are records of their own.  Rows with null ids are records too.  Repeated rows are records
    each; they follow one another and are cut like any group.  With fewer records than shards some shards
    stay empty; an empty table gives an empty result.  A text of any length is one record; one that is larger than a shard makes
    its shard larger.  Other columns, whatever their names, are ignored or, with ``whole``, handed on in row.
    """
    scratch = Scratch(docs.sparkSession)
    kept = ["row"] * whole
    rows = scratch.save(_sized(docs, id_col, text_col, whole), bytes=F.sum("size"))
    count, total = max(1, rows.counts["rows"]), max(1, rows.counts["bytes"] or 0)
    ranges = max(RANGES * shards, -(-count // RANGE_ROWS))
    splitters = scratch.save(_splitters(rows, ranges, total, count, seed))
    ranged = scratch.save(_ranged(rows, splitters))
    scratch.drop(rows)
    cut = _subdivided(ranged, ranges, total, count)

    own = Window.partitionBy("range", "sub").orderBy(*KEY)
    local = cut.withColumn("inner_rank", F.row_number().over(own)).withColumn("inner", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    local = scratch.save(local.select("range", "sub", "doc_id", "size", "text_crc32", "h", "inner", "inner_rank", *kept))
    scratch.drop(ranged)
    totals = local.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range", "sub")  # a row per range
    totals = totals.select("range", "sub", (F.sum("b").over(before) - F.col("b")).alias("b0"), (F.sum("n").over(before) - F.col("n")).alias("n0"))
    placed = local.join(F.broadcast(totals), ["range", "sub"])
    placed = placed.select("doc_id", "size", "text_crc32", "h", (F.col("b0") + F.col("inner")).alias("start"), (F.col("n0") + F.col("inner_rank") - 1).alias("rank"), *kept)
    out = _dealt(placed, shards, total)
    first = F.broadcast(out.groupBy("shard").agg(F.min("rank").alias("first")))  # a row per shard
    return out.join(first, "shard").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("rank") - F.col("first")).alias("slot"), *kept)


def _dealt(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``placed`` with shard; positions are counted in bytes times twice the shards, so that cuts are whole numbers.

    A record goes where its middle lies.
    """
    unit = 2 * shards
    at = lambda c: F.floor(c / total)  # noqa: E731  in double, put right by what follows
    end = F.col("start") + F.col("size")
    crossed = placed.where(at((F.col("start") - 1) * shards) < at((end + 1) * shards)).select("h", "start", end.alias("end"))
    crossed = crossed.withColumn("cut", F.explode(F.sequence(F.greatest(F.lit(1), at((F.col("start") - 1) * shards)), F.greatest(F.lit(1), at((F.col("end") + 1) * shards)))))
    crossed = crossed.where(f"cut < {shards} and start * {shards} <= cut * {total} and cut * {total} < end * {shards}").select("cut", "h")  # one record for each cut
    group = placed.join(F.broadcast(crossed.select("h").distinct()), "h").groupBy("h").agg(F.min("start").alias("lo"), F.max(end).alias("hi"))
    cut = F.col("cut") * 2 * total
    lo, hi = F.col("lo") * unit, F.col("hi") * unit
    moved = F.when((hi - lo) * TOLERANCE <= 2 * total, F.when(cut - lo < hi - cut, lo).otherwise(hi)).otherwise(cut)
    cuts = crossed.join(group, "h").select("cut", moved.alias("pos"))
    every = placed.sparkSession.range(shards).withColumnRenamed("id", "near")
    cuts = every.join(cuts.select(F.col("cut").alias("near"), F.col("pos").alias("lower")), "near", "left").join(cuts.select((F.col("cut") - 1).alias("near"), F.col("pos").alias("upper")), "near", "left")
    middle = F.col("start") * unit + F.col("size") * shards
    near = F.least(F.greatest(F.expr(f"(start * {unit} + size * {shards}) div {2 * total}"), F.lit(0)), F.lit(shards - 1))
    out = placed.withColumn("near", near).join(F.broadcast(cuts), "near")  # a row per shard
    shard = F.col("near") + F.when(middle >= F.col("upper"), 1).otherwise(0) - F.when(middle < F.col("lower"), 1).otherwise(0)
    return out.withColumn("shard", shard).drop("near", "lower", "upper")


def write_shards(docs: DataFrame, path: str, shards: int = 16, file_rows: int = 1_000_000, **options) -> str:
    """Write whole rows of ``docs`` under ``path``, a folder for each shard, in the order of slots, in files of ``file_rows`` rows.

    Returns the name of the column by which the folders are called: shard, with underscores after it where ``docs`` has such a column.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    out = shard_records(docs, shards, whole=True, **options)
    out = out.withColumn("_file", F.expr(f"slot div {file_rows}")).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    out.select(F.col("shard").alias(name), "row.*").write.partitionBy(name).parquet(path)
    return name
