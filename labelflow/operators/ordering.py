"""Ordered merge of streams, sequences and promises, on batch DataFrames.

An ordered port merges its streams by time.  After an arrival a its watermark W(a) is the least, over the streams seen so far, of a
stream's greatest time, less the lateness.  A message of time t is released by the first arrival from its own on
whose watermark is at least t, and it is late if an arrival before its own has released a greater time.
That definition is computed as it stands, by running values over slices of the arrivals: no state is carried
from message to message, no task holds a port.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.tables import first_reaching, numbered, running, written

OUTCOMES = {"drop": "dropped", "pass": "late", "route": "routed"}


def watermarks(df: DataFrame, port: str, arrival: str, ts: str, lateness: int = 0, stream: str | None = None, streams: tuple = (), idle: int | None = None, clock: str | None = None) -> DataFrame:
    """``df`` with _w, the port's watermark after each arrival, and _turn, the stretch of arrivals in which it only rises.

    A watermark falls when a stream shows up with an earlier time: for the first time, or, with ``idle``, after it
    has sent nothing for so long on the ``clock`` column and was left out meanwhile.  streams: the values of the
    ``stream`` column, a declared list; without it all messages are one stream.
    """
    every = {f"_m{k}": F.col(stream) == s for k, s in enumerate(streams)} if streams else {"_m0": F.lit(True)}
    values = {m: ("max", F.when(own, F.col(ts))) for m, own in every.items()}
    if idle is not None:
        values |= {m.replace("_m", "_c"): ("max", F.when(own, F.col(clock))) for m, own in every.items()}
    x = running(df, arrival, (port,), strict=True, **values)

    def least(marks: list[Column]) -> Column:
        return (F.least(*marks) if len(marks) > 1 else marks[0]) - lateness

    now = {m: F.greatest(F.col(m), F.when(own, F.col(ts))) for m, own in every.items()}
    if idle is not None:
        before = [F.when(F.col(clock) - F.col(m.replace("_m", "_c")) < idle, F.col(m)) for m in every]
        after = [F.when(every[m] | (F.col(clock) - F.col(m.replace("_m", "_c")) < idle), now[m]) for m in every]
    else:
        before, after = [F.col(m) for m in every], [now[m] for m in every]
    x = x.select(*df.columns, least(before).alias("_before"), least(after).alias("_w"))
    # a stream that has dropped out only lifts the watermark, so what lies below _before includes every fall
    fell = F.when(F.coalesce(F.col("_w") < F.col("_before"), F.lit(True)), 1)
    return running(x, arrival, (port,), _turn=("count", fell)).drop("_before")


def releases(df: DataFrame, port: str, arrival: str, ts: str, lateness: int = 0, stream: str | None = None, streams: tuple = (), idle: int | None = None, clock: str | None = None) -> DataFrame:
    """``df`` with released_at: the arrival that releases each message; null if only the end of the input does.

    Between two falls the watermark only rises, so the first arrival that reaches a time is a running least value there.  Messages that
    are still held at a fall go to the first later stretch that reaches them.
    """
    x = written(watermarks(df, port, arrival, ts, lateness, stream, streams, idle, clock))
    keys = (port, "_turn")
    levels = x.select(*keys, F.col(arrival).alias("_at"), F.col("_w").alias("_level"))
    found = first_reaching(levels, x.select(*df.columns, "_turn", F.col(ts).alias("_want")), keys)
    out = found.select(*df.columns, F.when(F.col("_first").isNotNull(), F.greatest("_first", F.col(arrival).cast("long"))).alias("released_at"), "_turn")
    if len(streams) < 2 and idle is None:
        return out.drop("_turn")
    out = written(out)
    held = out.where("released_at is null")
    tops = x.groupBy(*keys).agg(F.max("_w").alias("_top")).select(F.col(port).alias("_p"), F.col("_turn").alias("_t"), "_top")
    later = held.join(tops, held[port].eqNullSafe(tops["_p"]) & (F.col("_t") > F.col("_turn")) & (F.col("_top") >= F.col(ts)), "left")
    later = written(later.groupBy(*df.columns).agg(F.min("_t").alias("_turn")))
    found = first_reaching(levels, later.where("_turn is not null").select(*df.columns, "_turn", F.col(ts).alias("_want")), keys)
    rest = found.select(*df.columns, F.col("_first").alias("released_at")).unionByName(later.where("_turn is null").select(*df.columns, F.lit(None).cast("long").alias("released_at")))
    return out.where("released_at is not null").drop("_turn").unionByName(rest)


def with_late(released: DataFrame, port: str, arrival: str, ts: str, per: str | None = None) -> DataFrame:
    """``released`` (with released_at) with late: an earlier arrival has released a greater time of the port, or of the key ``per`` in it."""
    released, keys = written(released), (port, per) if per else (port,)
    a = F.col(arrival).cast("long")
    own = released.select(*released.columns, (2 * a).alias("_o"), F.lit(None).cast("long").alias("_t"), F.lit(True).alias("_own"))
    told = released.where("released_at is not null").select(*keys, (2 * F.col("released_at") + 1).alias("_o"), F.col(ts).cast("long").alias("_t"), F.lit(False).alias("_own"))
    out = running(own.unionByName(told, allowMissingColumns=True), "_o", keys, _top=("max", F.col("_t"))).where("_own")
    return out.select(*released.columns, F.coalesce(F.col("_top") > F.col(ts), F.lit(False)).alias("late"))


def ordered_merge(df: DataFrame, port: str, stream: str, streams: tuple, arrival: str, ts: str, lateness: int = 0, on_late: str = "drop", per: str | None = None, idle: int | None = None, clock: str | None = None) -> DataFrame:
    """``df`` with outcome (released, or dropped, late, routed as ``on_late`` says) and emitted_at.

    emitted_at is the arrival at which the port hands a message on: a released message's release (null: with the end
    of the input), a late one's own arrival, nothing for a dropped one.  Messages leave in the order of emitted_at, late
    ones first, then ts, stream and arrival (``in_order``).  Arrivals are unique whole numbers, times whole numbers.
    """
    x = with_late(releases(df, port, arrival, ts, lateness, stream, streams, idle, clock), port, arrival, ts, per)
    late = F.col("late")
    emitted = F.when(~late, F.col("released_at")) if on_late == "drop" else F.when(late, F.col(arrival)).otherwise(F.col("released_at"))
    return x.select(*df.columns, F.when(late, OUTCOMES[on_late]).otherwise("released").alias("outcome"), emitted.cast("long").alias("emitted_at"))


def in_order(merged: DataFrame, port: str, stream: str, arrival: str, ts: str) -> DataFrame:
    """What the ports hand on, with position from 1 in their order of release."""
    order = [F.col("emitted_at").asc_nulls_last(), F.col("outcome") == "released", F.col(ts), F.col(stream), F.col(arrival)]
    return numbered(merged.where("outcome <> 'dropped'"), (port,), order)


def late_single_stream(df: DataFrame, port: str, arrival: str, ts: str, lateness: int = 0) -> DataFrame:
    """``df`` with late, for ports fed by one stream."""
    return with_late(releases(df, port, arrival, ts, lateness), port, arrival, ts).drop("released_at")


def merge_arrays(stream: np.ndarray, ts: np.ndarray, held: np.ndarray, tops: dict, last: int | None, lateness: int) -> tuple[np.ndarray, np.ndarray, dict, int | None]:
    """The same rule over one port's arrivals of a micro-batch, in arrays; for the streaming twin.

    held: times of messages kept from before.  tops: each stream's greatest time, last: the greatest time released so far.
    Returns (release index of the held messages and of the arrivals, in one array, -1 for those still held; late, of the
    arrivals; the new tops; the new last).
    """
    n = len(ts)
    level = np.full(n, np.iinfo(np.int64).max)
    tops = dict(tops)
    for s in dict.fromkeys([*tops, *stream.tolist()]):
        own = np.where(stream == s, ts, np.iinfo(np.int64).min)
        top = np.maximum(np.maximum.accumulate(own), tops.get(s, np.iinfo(np.int64).min)) if n else own
        level = np.where(top > np.iinfo(np.int64).min, np.minimum(level, top), level)
        if n:
            tops[s] = int(top[-1])
    level = level - lateness
    turn = np.flatnonzero(np.concatenate([[True], level[1:] < level[:-1]])) if n else np.zeros(0, np.int64)
    want, since = np.concatenate([held, ts]), np.concatenate([np.zeros(len(held), np.int64), np.arange(n)])
    out = np.full(len(want), -1)
    for lo, hi in zip(turn, np.append(turn[1:], n)):  # the watermark rises within each stretch
        at = np.maximum(lo + np.searchsorted(level[lo:hi], want), since)
        new = (out < 0) & (at < hi) & (since < hi)
        out[new] = at[new]
    top = np.full(n + 1, np.iinfo(np.int64).min if last is None else last)
    np.maximum.at(top, out[out >= 0] + 1, want[out >= 0])
    top = np.maximum.accumulate(top)
    return out, ts < top[:n], tops, None if top[-1] == np.iinfo(np.int64).min else int(top[-1])


def sequence_gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, gap_from, gap_to): runs of missing numbers between those present, from 0."""
    present = df.select(key, seq).distinct()
    prev = F.coalesce(F.lag(seq).over(Window.partitionBy(key).orderBy(seq)), F.lit(-1))
    return present.withColumn("_p", prev).where(F.col(seq) > F.col("_p") + 1).select(key, (F.col("_p") + 1).alias("gap_from"), (F.col(seq) - 1).alias("gap_to"))


def sequence_dedup(df: DataFrame, key: str, seq: str, arrival: str) -> DataFrame:
    """One row per key and number, the last that arrived (a buffered duplicate is overwritten)."""
    last = F.max(F.struct(F.col(arrival), F.struct(*[F.col(c) for c in df.columns]).alias("row"))).alias("m")
    return df.groupBy(key, seq).agg(last).select("m.row.*")


def broken_promises(df: DataFrame, key: str, order: str, ts: str, within: int) -> DataFrame:
    """Rows whose time is more than ``within`` before the greatest time their key has sent; they are sent all the same."""
    top = running(df, order, (key,), strict=True, promised_from=("max", F.col(ts) - within))
    return top.where(F.col(ts) < F.col("promised_from"))


def sequence_release(df: DataFrame, key: str, seq: str, arrival: str) -> DataFrame:
    """(key, seq, released_at): when a sequenced port hands each number on, null while a gap below holds it.

    A number goes once it and all below it, from 0, have arrived; duplicates count by their first arrival.
    """
    first = df.groupBy(key, seq).agg(F.min(arrival).alias("_a"))
    w = Window.partitionBy(key).orderBy(seq)
    whole = F.row_number().over(w) - 1 == F.col(seq)
    return first.select(key, seq, F.when(whole, F.max("_a").over(w)).alias("released_at"))
