"""Structured Streaming twins of the batch operators.

State lives in Spark's state store and checkpoints; the ordered merge keeps what it holds there, keyed by port.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelflow.operators.ordering import OUTCOMES, merge_arrays


def running_sum(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, order, value, total) of a stream: each record with its key's total so far, in order within a batch."""
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        total = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(batches)).sort_values(order)
        out = pdf[[key, order, value]].assign(total=total + pdf[value].cumsum())
        state.update((float(out["total"].iloc[-1]),))
        yield out

    schema = f"{key} {kind[key]}, {order} {kind[order]}, {value} {kind[value]}, total double"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "total double", "append", GroupStateTimeout.NoTimeout)


def ordered_merge(stream: DataFrame, port: str, source: str, arrival: str, ts: str, lateness: int = 0, on_late: str = "drop", idle_ms: int | None = None, most_held: int = 1 << 20) -> DataFrame:
    """(port, arrival, ts, outcome) of a stream of messages, released by the rule of batch ``ordered_merge``.

    State is what the port holds, each stream's greatest time and the greatest time released.  With ``idle_ms`` a port that
    receives nothing for so long releases what it holds; one that holds more than ``most_held`` messages
    after a micro-batch releases the earliest of them beforehand.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    columns = [source, arrival, ts]

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        held, tops, last = pickle.loads(state.get[0]) if state.exists else (None, {}, None)
        new = pd.concat([b[columns] for b in batches]).sort_values(arrival) if not state.hasTimedOut else None
        rows = pd.concat([x for x in (held, new) if x is not None], ignore_index=True)
        n = 0 if held is None else len(held)
        at, late, tops, last = merge_arrays(rows[source].to_numpy()[n:], rows[ts].to_numpy()[n:], rows[ts].to_numpy()[:n], tops, last, lateness)
        rows["at"], rows["late"] = at, np.concatenate([np.zeros(n, bool), late])
        if state.hasTimedOut:
            rows["at"] = 0
        rows = rows.sort_values([ts, source, arrival])
        kept = rows[(rows["at"] < 0) & ~rows["late"]]
        early = kept.index[: max(0, len(kept) - most_held)]
        rows.loc[early, "at"] = len(at)
        gone, kept = rows[(rows["at"] >= 0) | rows["late"]], kept.drop(early)
        for t in gone.loc[~gone["late"], ts].tail(1):
            last = t if last is None else max(last, t)
        gone = gone.assign(outcome=np.where(gone["late"], OUTCOMES[on_late], "released")).sort_values("at", kind="stable")
        state.update((pickle.dumps((kept[columns], tops, last)),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield gone.assign(**{port: k[0]})[[port, arrival, ts, "outcome"]]

    schema = f"{port} {kind[port]}, {arrival} {kind[arrival]}, {ts} {kind[ts]}, outcome string"
    return stream.groupBy(port).applyInPandasWithState(run, schema, "merge binary", "append", timeout)


def latest_per_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest record of each key and how many came; for output mode update."""
    row = F.struct(*[F.col(c) for c in stream.columns])
    return stream.groupBy(key).agg(F.max_by(row, order).alias("latest"), F.count(F.lit(1)).alias("served"))


def window_averages(stream: DataFrame, time: str, keys: tuple, value: str, width: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Averages of tumbling windows, emitted once the watermark has passed them."""
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "avg_value", "n")


def median_join(plug: DataFrame, overall: DataFrame, delay: str = "300 seconds") -> DataFrame:
    """Plug medians joined to the overall median of the same time; state is held for ``delay``."""
    p, g = plug.withWatermark("ts", delay), overall.withWatermark("ts", delay).withColumnRenamed("ts", "gts")
    return p.join(g, F.expr("ts = gts")).drop("gts")
