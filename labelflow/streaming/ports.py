"""Ports with timers as Structured Streaming operators, by ``transformWithStateInPandas``.

State is kept in maps of the state store (RocksDB), an entry per held message, stream or slice; an arrival or timer rewrites the entries it
changes.  A port holds ``most_bytes`` at most, so what a task loads for a key is bounded.  Set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which these operators need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from labelflow.operators.ports import MOST_BYTES, OrderedPort, SequencedPort

#: The state store that timers and maps need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(row) -> tuple:
    return tuple(v.item() if hasattr(v, "item") else v for v in row)


class _Timed(StatefulProcessor):
    """One timer per key, at the time the port says; what comes out is (key, message columns, outcome, at, detail)."""

    def __init__(self, names: list[str], schema: str):
        self.names, self.schema = names, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due long")

    def _set_timer(self, due: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == due:
            return
        if old is not None and old in set(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def _frame(self, key, events) -> pd.DataFrame:
        none = (None,) * (len(self.names) - 1)
        rows = [(*key, *(m if m is not None else none), outcome, at, detail) for outcome, m, at, detail in events]
        return pd.DataFrame(rows, columns=[*self.names, "outcome", "at", "detail"])

    def close(self) -> None:
        pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        port, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        self.timer.clear()
        events = []
        while (due := port.due()) is not None and due <= max(now, timerValues.getCurrentProcessingTimeInMs()):
            events += port.fire(due)
        self._store(port)
        if events:
            yield self._frame(key, events)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        port, now, events = self._load(), timerValues.getCurrentProcessingTimeInMs(), []
        new = pd.concat(list(rows)).sort_values(self.arrival)
        for row in new[self.names[1:]].itertuples(index=False, name=None):
            events += self._offer(port, _plain(row), now)
        self._store(port)
        if events:
            yield self._frame(key, events)


class _Sequenced(_Timed):
    def __init__(self, names, schema, seq, arrival, size, gap, most_bytes):
        super().__init__(names, schema)
        self.seq, self.arrival, self.size, self.gap, self.most_bytes = seq, arrival, size, gap, most_bytes

    def init(self, handle):
        super().init(handle)
        self.port = handle.getValueState("port", "next long, since long")
        self.held = handle.getMapState("held", "number long", f"size long, {self.schema}")

    def _load(self):
        port = SequencedPort(self.gap, self.most_bytes)
        if self.port.exists():
            port.next, port.since = self.port.get()
        for (n,), (size, *message) in self.held.iterator():
            port.held[n] = (size, tuple(message))
            port.bytes += size
        self.before = dict(port.held)
        return port

    def _offer(self, port, message, now):
        at = self.names.index
        return list(port.offer(message[at(self.seq) - 1], message[at(self.size) - 1] or 0 if self.size else 0, message, now))

    def _store(self, port):
        self.port.update((port.next, port.since))
        for n in self.before.keys() - port.held.keys():
            self.held.removeKey((n,))
        for n, (size, message) in port.held.items():
            if self.before.get(n) != (size, message):
                self.held.updateValue((n,), (size, *message))
        self._set_timer(port.due())


class _Ordered(_Timed):
    def __init__(self, names, schema, kinds, source, ts, arrival, size, per, options):
        super().__init__(names, schema)
        self.kinds, self.source, self.ts, self.arrival, self.size, self.per, self.options = kinds, source, ts, arrival, size, per, options

    def init(self, handle):
        super().init(handle)
        self.port = handle.getValueState("port", "watermark long, last long")
        self.streams = handle.getMapState("streams", f"name {self.kinds[self.source]}", "top long, heard long, active boolean")
        self.held = handle.getMapState("held", f"ts long, source {self.kinds[self.source]}, arrival long", f"size long, {self.schema}")
        self.lasts = handle.getMapState("lasts", f"per {self.kinds[self.per]}", "last long") if self.per else None

    def _per(self, message):
        return message[self.names.index(self.per) - 1] if self.per else None

    def _load(self):
        port = OrderedPort(per_key=bool(self.per), **self.options)
        if self.port.exists():
            port.watermark, port.last = self.port.get()
        port.streams = {s: list(v) for (s,), v in self.streams.iterator()}
        for (ts, source, arrival), (size, *message) in self.held.iterator():
            heapq.heappush(port.held, (ts, source, arrival, size, self._per(message), tuple(message)))
            port.bytes += size
        if self.lasts is not None:
            port.last_per = {p: last for (p,), (last,) in self.lasts.iterator()}
        self.before = {x[:3] for x in port.held}, {s: list(v) for s, v in port.streams.items()}, dict(port.last_per)
        return port

    def _offer(self, port, message, now):
        value = lambda c: message[self.names.index(c) - 1]
        size = value(self.size) or 0 if self.size else 0
        return list(port.offer(value(self.source), value(self.ts), value(self.arrival), size, self._per(message), message, now))

    def _store(self, port):
        held, streams, lasts = self.before
        self.port.update((port.watermark, port.last))
        now = {x[:3]: x for x in port.held}
        for k in held - now.keys():
            self.held.removeKey(k)
        for k in now.keys() - held:
            self.held.updateValue(k, (now[k][3], *now[k][5]))
        for s, v in port.streams.items():
            if streams.get(s) != v:
                self.streams.updateValue((s,), tuple(v))
        for p, last in port.last_per.items() if self.lasts is not None else ():
            if lasts.get(p) != last:
                self.lasts.updateValue((p,), (last,))
        self._set_timer(port.due())


def _parts(stream: DataFrame, key: str) -> tuple[DataFrame, list[str], str, dict]:
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    names = [key, *[c for c in stream.columns if c != key]]
    return stream.select(*names), names, ", ".join(f"{c} {kinds[c]}" for c in names[1:]), kinds


def sequenced_port(stream: DataFrame, key: str, seq: str, arrival: str, gap_ms: int | None = None, size: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of ``stream`` with outcome, at (processing time in ms) and detail, by the rule of ``SequencedPort``, a port per key.

    Rows of a micro-batch count in the order of ``arrival``.  skipped and overflow are reports: their other columns are null.
    """
    src, names, schema, kinds = _parts(stream, key)
    out = f"{key} {kinds[key]}, {schema}, outcome string, at long, detail string"
    return src.groupBy(key).transformWithStateInPandas(_Sequenced(names, schema, seq, arrival, size, gap_ms, most_bytes), out, "append", "ProcessingTime")


def ordered_port(stream: DataFrame, port: str, source: str, arrival: str, ts: str, lateness: int = 0, on_late: str = "dropped", per: str | None = None, idle_ms: int | None = None, size: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of ``stream`` with outcome, at (processing time in ms) and detail, by the rule of ``OrderedPort``.

    A stream that is idle for ``idle_ms`` stops holding back its port while others still send, since each port keeps
    when each stream was heard and one timer at the earliest of them.  outcome is released (detail early: because of ``most_bytes`` of the column
    ``size``), ``on_late`` for late messages, or overflow, a report.
    """
    src, names, schema, kinds = _parts(stream, port)
    options = {"lateness": lateness, "idle": idle_ms, "most_bytes": most_bytes, "on_late": on_late}
    out = f"{port} {kinds[port]}, {schema}, outcome string, at long, detail string"
    return src.groupBy(port).transformWithStateInPandas(_Ordered(names, schema, kinds, source, ts, arrival, size, per, options), out, "append", "ProcessingTime")


class _Slices(StatefulProcessor):
    def __init__(self, key, slice_, value, tick_ms, kept):
        self.key, self.slice, self.value, self.tick_ms, self.kept = key, slice_, value, tick_ms, kept

    def init(self, handle):
        self.handle = handle
        self.sums = handle.getMapState("sums", "slice long", "total double, n long, fresh boolean")
        self.began = handle.getValueState("began", "due long")

    def close(self):
        pass

    def handleInputRows(self, key, rows, timerValues):
        if not self.began.exists():
            due = timerValues.getCurrentProcessingTimeInMs() + 2 * self.tick_ms
            self.handle.registerTimer(due)
            self.began.update((due,))
        for pdf in rows:
            part = pdf.dropna(subset=[self.value]).groupby(self.slice)[self.value].agg(["sum", "count"])
            for s, total, n in part.itertuples(name=None):
                old, many, _ = self.sums.getValue((int(s),)) if self.sums.containsKey((int(s),)) else (0.0, 0, True)
                self.sums.updateValue((int(s),), (old + float(total), many + int(n), True))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = sorted((k[0], v) for k, v in self.sums.iterator())
        out = [(*key, s, total / n, n) for s, (total, n, fresh) in held if fresh]
        for s, (total, n, fresh) in held:
            if s <= held[-1][0] - self.kept:
                self.sums.removeKey((s,))
            elif fresh:
                self.sums.updateValue((s,), (total, n, False))
        due = max(expiredTimerInfo.getExpiryTimeInMs() + 2 * self.tick_ms, timerValues.getCurrentProcessingTimeInMs() + 1)
        self.handle.registerTimer(due)
        self.began.update((due,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "slice", "avg_value", "n"])


def slice_averages(stream: DataFrame, key: str, time: str, value: str, width: int, tick_ms: int = 15_000, kept: int = 8) -> DataFrame:
    """(key, slice, avg_value, n): every second tick of the processing time, the averages of the slices that have changed since.

    A slice is floor(time / width), time in seconds.  All records count, also those of the micro-batch that an emission falls into.  A key
    keeps its last ``kept`` slices; a slice that has been let go begins anew if a record for it still comes.
    """
    kind = stream.schema[key].dataType.simpleString()
    src = stream.select(key, F.floor(F.col(time) / width).cast("long").alias("slice"), F.col(value).cast("double").alias("value"))
    return src.groupBy(key).transformWithStateInPandas(_Slices(key, "slice", "value", tick_ms, kept), f"{key} {kind}, slice long, avg_value double, n long", "update", "ProcessingTime")


class _Registry(StatefulProcessor):
    def __init__(self, names, kind):
        self.names, self.kind = names, kind

    def init(self, handle):
        self.entry = handle.getValueState("entry", f"version long, value {self.kind}, present boolean")

    def close(self):
        pass

    def handleInitialState(self, key, initialState, timerValues):
        key_, seq, action, value = self.names
        row = initialState.sort_values(seq).iloc[-1]
        self.entry.update(_plain((row[seq], row[value], True)))

    def handleInputRows(self, key, rows, timerValues):
        key_, seq, action, value = self.names
        version = self.entry.get()[0] if self.entry.exists() else None
        new = pd.concat(list(rows)).sort_values(seq).drop_duplicates(seq)
        new = new if version is None else new[new[seq] > version]
        if len(new):
            last = new.iloc[-1]
            present = last[action] != "delete"
            self.entry.update(_plain((last[seq], last[value] if present else None, bool(present))))
            yield new.assign(**{key_: key[0]})[self.names]


def registry_stream(feed: DataFrame, snapshot: DataFrame, key: str, seq: str, action: str, value: str) -> DataFrame:
    """The changes of ``feed`` (key, seq, action, value) that are news to the state begun from ``snapshot`` (key, seq, value).

    State starts from the snapshot, a batch table with the number of each entry's last change.  A change counts once, if its number is above that of
    its key's last: replays, and changes from before the snapshot, bring nothing.
    """
    names = [key, seq, action, value]
    kinds = {f.name: f.dataType.simpleString() for f in feed.schema.fields}
    first = snapshot.select(key, F.col(seq).cast("long").alias(seq), value).groupBy(key)
    out = ", ".join(f"{c} {kinds[c]}" for c in names)
    return feed.select(*names).groupBy(key).transformWithStateInPandas(_Registry(names, kinds[value]), out, "append", "None", first)
