"""Inputs as DataFrames, and running values over ranges of a global order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_date(F.col(ts).cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions: seq, ts, sensitivity, entity_id, state."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_seconds("ts").alias("ts"), F.pmod(F.col("event_id"), F.lit(3)).alias("sensitivity"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("state"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as load readings of plugs: seq, ts, value, property, house, household, plug."""
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_seconds("ts").alias("ts"), "value", F.when(F.col("event_type") != "error", 1).otherwise(0).alias("property"), (u % 3).alias("house"), (u % 5).alias("household"), u.alias("plug"))


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as camera frames and wearable records: seq, ts, kind, person, heart_rate, spo2."""
    kind = F.when(F.col("event_type").isin("view", "click"), "frame").otherwise("wearable")
    v = F.col("value").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), epoch_seconds("ts").alias("ts"), kind.alias("kind"),
        F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("resident-"), (F.col("user_id") % 7).cast("string"))).alias("person"),
        (60 + v % 40).alias("heart_rate"), (90 + v % 10).alias("spo2"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders as message arrivals: edge, origin and arrival day numbers, bytes, label."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    m = l.select("l_orderkey", "l_linenumber", F.concat(F.lit("pipe-"), (F.col("l_suppkey") % 7).cast("string")).alias("edge"), "l_shipdate", "l_quantity", "l_returnflag").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return m.select(
        F.col("l_orderkey").alias("msg"), F.col("l_linenumber").alias("part"), "edge", F.unix_date(F.col("o_orderdate").cast("date")).alias("origin"),
        F.unix_date(F.col("l_shipdate").cast("date")).alias("arrival"), F.col("l_quantity").cast("long").alias("bytes"),
        F.when(F.col("l_returnflag") == "N", "public").when(F.col("l_returnflag") == "A", "client").otherwise("internal").alias("label"))


_local: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table read back, so that steps which use it several times do not compute it anew.

    It lies in ``spark.checkpoint.dir``, which all executors of a cluster share, until the application ends.  A local
    application without the setting gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="labelflow-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        folder = _local[app]
    name = f"{folder.rstrip('/')}/labelflow-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


#: Width of a slice in values of the ordering column.
SLICE = 1 << 16


def running(df: DataFrame, order: str, keys: tuple = (), width: int = SLICE, strict: bool = False, **values) -> DataFrame:
    """``df`` with running values along the whole-number column ``order``, without one task for all rows.

    values: name=(kind, column) with kind sum, max, min, bit_and or count; the running value up to
    and including the row, or before it if ``strict``.  Rows are cut into slices of ``width``
    values; a slice runs by itself and what came before it is the fold of the earlier slices'
    totals.  Ties in ``order`` follow no fixed order; use a unique column.
    """
    fold = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "bit_and": F.bit_and}
    both = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": F.greatest, "min": F.least, "bit_and": lambda a, b: F.coalesce(a.bitwiseAND(b), a, b)}
    df = df.withColumn("_slice", F.floor(F.col(order) / width).cast("long"))
    local = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    cols = {n: (F.when(c.isNotNull(), 1).otherwise(0) if kind == "count" else c) for n, (kind, c) in values.items()}
    totals = df.groupBy(*keys, "_slice").agg(*[fold[values[n][0]](c).alias(f"_t_{n}") for n, c in cols.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", *[fold[values[n][0]](f"_t_{n}").over(before).alias(f"_b_{n}") for n in cols])
    out = df.select("*", *[fold[values[n][0]](c).over(local).alias(f"_l_{n}") for n, c in cols.items()])
    on = [out[k].eqNullSafe(totals[k]) for k in keys] + [out["_slice"] == totals["_slice"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = out.join(totals, cond)
    return joined.select(*[out[c] for c in df.columns if c != "_slice"], *[both[values[n][0]](joined[f"_b_{n}"], joined[f"_l_{n}"]).alias(n) for n in cols])


def numbered(df: DataFrame, keys: tuple, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``: the rows of each key numbered from 1 by ``order``, without one task for a key.

    Rows are range-partitioned by key and order; a partition numbers its own rows, and what came before it is the count of the
    earlier ones.
    """
    x = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    counts = x.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_base"))
    x = x.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return x.join(base, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_row") + F.col("_base")).cast("long").alias(name))


def first_reaching(levels: DataFrame, asks: DataFrame, keys: tuple = ()) -> DataFrame:
    """``asks`` (keys, ..., _want) with _first: the least _at among levels (keys, _at, _level) of its key with _level >= _want.

    Levels and wants are whole numbers.  Both are put in one falling order, in which the answer is a
    running least value: no row is paired with another.
    """
    kept = [c for c in asks.columns if c != "_want"]
    rows = F.struct(*[F.col(c) for c in kept]) if kept else F.lit(1)
    told = levels.select(*keys, (-2 * F.col("_level") - 1).cast("long").alias("_o"), F.col("_at").cast("long").alias("_c"))
    asked = asks.select(*keys, (-2 * F.col("_want")).cast("long").alias("_o"), rows.alias("_row"), F.lit(True).alias("_ask"))
    marks = asked.unionByName(told, allowMissingColumns=True).where("_o is not null")
    out = running(marks, "_o", keys, _first=("min", F.col("_c"))).where("_ask")
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in kept], "_first")


def time_slices(df: DataFrame, time: str, back: int, slice_seconds: int | None = None) -> DataFrame:
    """``df`` with _slice and _own: each row in its own slice of time and, where windows of later
    slices reach back to it, in those too.

    A window that looks back at most ``back`` seconds can then be partitioned by _slice (and keys):
    rows with _own have all they look back to in their slice.  No task holds more
    than two slices' width of rows of a key.
    """
    width = max(slice_seconds or 4 * back, back, 1)
    own = F.floor(F.col(time) / width).cast("long")
    last = F.floor((F.col(time) + back) / width).cast("long")
    out = df.withColumn("_home", own).withColumn("_slice", F.explode(F.sequence(own, last)))
    return out.withColumn("_own", F.col("_home") == F.col("_slice")).drop("_home")
