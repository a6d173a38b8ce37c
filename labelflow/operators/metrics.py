"""Measurements: meters, four kinds of percentile, throughput, histograms, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.tables import numbered, running, time_slices


def latency_nearest(df: DataFrame, keys: tuple, value: str) -> DataFrame:
    """n, mean, p50, p95, p99, max by nearest rank: the smallest value at or above ceil(q * n) of all."""
    q = lambda x: F.expr(f"percentile_disc({x}) within group (order by {value})")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("max"))


def latency_linear(df: DataFrame, keys: tuple, value: str) -> DataFrame:
    """p50, p95, p99 and p1 with linear interpolation."""
    return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p1", 0.01))])


def _by_count(df: DataFrame, keys: tuple, value: str, weight: Column) -> DataFrame:
    """(keys, value, w, upto, total): distinct values with running weights; small next to the input."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    return v.withColumn("upto", F.sum("w").over(w.orderBy(value))).withColumn("total", F.sum("w").over(w))


def latency_floor(df: DataFrame, keys: tuple, value: str, qs=(0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by index floor(q * n), from 0, at most n - 1."""
    v = _by_count(df, keys, value, F.lit(1))
    at = lambda q: F.least(F.floor(F.col("total") * q), F.col("total") - 1)
    return v.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in qs])


def latency_weighted(df: DataFrame, keys: tuple, value: str, weight: str) -> DataFrame:
    """Weighted mean and lower weighted median (the first value whose running weight reaches (W + 1) / 2), and the largest value."""
    v = _by_count(df, keys, value, F.col(weight))
    half = F.floor((F.col("total") + 1) / 2)
    return v.groupBy(*keys).agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"), F.min(F.when(F.col("upto") >= half, F.col(value))).alias("median"), F.max(value).alias("max"))


def histogram(df: DataFrame, keys: tuple, value: str, bins: int = 100) -> DataFrame:
    """(keys, bin, n, percent) of equal bins between each key's least and greatest value; the greatest is in the last."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return df.join(ends, list(keys)).withColumn("bin", b.cast("long")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 100.0 / F.max("total")).alias("percent"))


def trailing_throughput(df: DataFrame, keys: tuple, time: str, order: str, length: int) -> DataFrame:
    """``df`` with in_window: messages of the key in (t - length, t] up to the row itself; later rows of t do not count."""
    s = time_slices(df, time, length)
    part = Window.partitionBy(*keys, "_slice")
    upto = F.row_number().over(part.orderBy(time, order))
    old = F.count(F.lit(1)).over(part.orderBy(time).rangeBetween(Window.unboundedPreceding, -length))
    return s.withColumn("in_window", (upto - old).cast("long")).where("_own").drop("_slice", "_own")


def pipe_meter(df: DataFrame, pipe: str, time: str, size: str, interval: int) -> DataFrame:
    """(pipe, interval_start, messages, bytes, per_second) of tumbling intervals."""
    start = (F.floor(F.col(time) / interval) * interval).cast("long")
    return df.groupBy(pipe, start.alias("interval_start")).agg(F.count(F.lit(1)).alias("messages"), F.sum(size).alias("bytes"), (F.count(F.lit(1)) / float(interval)).alias("per_second"))


def sink_throughput(df: DataFrame, sink: str, time: str) -> DataFrame:
    """Mean and 1st percentile over a sink's time steps of the messages in each."""
    per = df.groupBy(sink, time).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(sink).agg(F.avg("n").alias("mean"), F.percentile("n", 0.01).alias("p1"))


def flow_slo(df: DataFrame, flow: str, latency: str, percentile: float, bound: float) -> DataFrame:
    """(flow, observed, met): the percentile of a flow's latencies against its bound."""
    return df.groupBy(flow).agg(F.percentile(latency, percentile).alias("observed")).withColumn("met", F.col("observed") <= bound)


def pivot_stats(df: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Mean and sample deviation of ``value`` by row and column; cells without rows hold 0."""
    p = df.groupBy(row).pivot(column, columns).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return p.na.fill(0.0)


def pivot_percent(df: DataFrame, row: str, columns: list[tuple[str, str]], config: str, interface: str, part: str, total: str) -> DataFrame:
    """Mean percentage part / total by row and (config, interface); an empty total counts as 1."""
    pct = F.col(part) * 100.0 / F.when(F.col(total) == 0, 1).otherwise(F.col(total))
    d = df.withColumn("_c", F.concat_ws("_", config, interface)).withColumn("_p", pct)
    return d.groupBy(row).pivot("_c", ["_".join(c) for c in columns]).agg(F.avg("_p"))


def registry_fold(log: DataFrame, key: str, seq: str, action: str, value: str) -> DataFrame:
    """(key, value): the state that a log of set and delete actions leaves; the last action of a key decides."""
    last = log.groupBy(key).agg(F.max_by(F.struct(action, value), seq).alias("m"))
    return last.where(F.col(f"m.{action}") != "delete").select(key, F.col(f"m.{value}").alias(value))


def percentile_lookup(table: DataFrame, keys: tuple, p: str, value: str, wanted: float) -> DataFrame:
    """The value at the smallest measured percentile at or above ``wanted``, else at the largest measured."""
    above = F.min(F.when(F.col(p) >= wanted, F.struct(p, value)))
    return table.groupBy(*keys).agg(F.coalesce(above, F.max(F.struct(p, value)))[value].alias(value))


def downsample(df: DataFrame, keys: tuple, time: str, order: str, step: int) -> DataFrame:
    """The rows at which a sampler of one row per ``step`` reads, times ascending with ``order``.

    The sampler waits for time step * c with c rows read so far and moves on by one a row.  So c after row i
    is the least of i + 1 and floor(t_j / step) + 1 + i - j over j <= i: a running minimum.
    """
    first = df.groupBy(*keys).agg(F.min(time).alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = numbered(df, keys, [F.col(order)], "_i").join(first, same).withColumn("_own", F.floor((F.col(time) - F.col("_first")) / step) + 1 - F.col("_i"))
    d = running(d.select(*df.columns, "_i", "_own"), "_i", keys, strict=True, _m=("min", F.col("_own")))
    before = F.when(F.col("_i") == 1, 0).otherwise(F.least(F.col("_i") - 1, F.col("_i") - 1 + F.col("_m")))
    return d.where(F.least(F.col("_i"), F.col("_i") + F.least("_m", "_own")) > before).select(*df.columns)


def apply_feed(snapshot: DataFrame, version: int, feed: DataFrame, key: str, seq: str, action: str, value: str) -> DataFrame:
    """(key, value): a snapshot (key, value) taken at ``version`` with the change feed applied to it.

    Changes up to the version are in the snapshot already and count no more; a change that the feed repeats
    counts once.
    """
    start = snapshot.select(key, F.lit(version).cast("long").alias(seq), F.lit("set").alias(action), value)
    return registry_fold(start.unionByName(feed.where(F.col(seq) > version).select(key, F.col(seq).cast("long").alias(seq), action, value)), key, seq, action, value)


def latest_keys(df: DataFrame, key: str, order: str, value: str, n: int = 300) -> DataFrame:
    """(key, value): a bounded map's content: the ``n`` keys that were inserted last, each with the value it was set to last."""
    state = df.groupBy(key).agg(F.min(order).alias("_in"), F.max_by(value, order).alias(value))
    return state.orderBy(F.desc("_in")).limit(n).select(key, value)


def agent_usage(df: DataFrame, agent: str, rss: str, cpu: str) -> DataFrame:
    """(agent, max_rss, mean_cpu) of resource records."""
    return df.groupBy(agent).agg(F.max(rss).alias("max_rss"), F.avg(cpu).alias("mean_cpu"))
