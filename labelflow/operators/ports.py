"""Ports with timers: what they do with arrivals at given times, and sequenced ports over batch tables.

A port is a small state that arrivals and its own timers change; both hand on messages.  The same rules serve the batch
operator here, where time is a column, and the streaming ones in ``labelflow.streaming.ports``, where it is the
processing time.  Timers fire at the time they are due, before an arrival at that time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes that a port holds at most.
MOST_BYTES = 64 << 20
#: (outcome, message, time, detail) of what a port hands on or reports.
Event = tuple[str, object, int, str | None]


class SequencedPort:
    """Hands on messages in the order of their numbers, from 0.

    A number below the next one is a duplicate; one that is held already replaces what was held.  While something is held, a timer runs from when
    the port began to wait: after ``gap`` the port skips to the least number held, and waits anew if something is left.  Holding
    more than ``most_bytes`` makes it skip at once.
    """

    def __init__(self, gap: int | None = None, most_bytes: int = MOST_BYTES):
        self.gap, self.most_bytes = gap, most_bytes
        self.next, self.since, self.bytes = 0, None, 0
        self.held: dict[int, tuple[int, object]] = {}

    def due(self) -> int | None:
        """When the timer fires, if it runs."""
        return self.since + self.gap if self.gap is not None and self.since is not None and self.held else None

    def _drain(self, now: int) -> Iterator[Event]:
        while self.next in self.held:
            size, message = self.held.pop(self.next)
            self.bytes -= size
            self.next += 1
            yield "released", message, now, None
        if not self.held:
            self.since = None

    def _skip(self, now: int) -> Iterator[Event]:
        first = min(self.held)
        yield "skipped", None, now, f"{self.next}..{first - 1}"
        self.next = first
        yield from self._drain(now)

    def fire(self, now: int) -> Iterator[Event]:
        yield from self._skip(now)
        self.since = now if self.held else None

    def offer(self, number: int, size: int, message, now: int) -> Iterator[Event]:
        while (due := self.due()) is not None and due <= now:
            yield from self.fire(due)
        if number < self.next:
            yield "duplicate", message, now, None
            return
        if number in self.held:
            old, replaced = self.held.pop(number)
            self.bytes -= old
            yield "replaced", replaced, now, None
        self.held[number] = (size, message)
        self.bytes += size
        yield from self._drain(now)
        if self.held and self.since is None:
            self.since = now
        if self.bytes > self.most_bytes:
            yield "overflow", None, now, f"{self.bytes} bytes"
            yield from self._skip(now)


class OrderedPort:
    """Merges streams by time.

    The watermark is the least of the active streams' greatest times, less ``lateness``, and stays where it was while none is
    active; messages up to it are handed on in order of time, stream and arrival.  A stream that has sent nothing for
    ``idle`` stops holding it back until it sends again.  A message behind the greatest time handed on (of its ``per`` value, where it
    has one and ``per_key`` is set) is late.  Holding more than ``most_bytes`` hands on the earliest beforehand.
    """

    def __init__(self, lateness: int = 0, idle: int | None = None, most_bytes: int = MOST_BYTES, on_late: str = "dropped", per_key: bool = False):
        self.lateness, self.idle, self.most_bytes, self.on_late, self.per_key = lateness, idle, most_bytes, on_late, per_key
        self.streams: dict[object, list] = {}  # greatest time, when it last sent, whether it is active
        self.held: list[tuple] = []  # a heap of (time, stream, arrival, size, per, message)
        self.watermark = self.last = None
        self.last_per: dict[object, int] = {}
        self.bytes = 0

    def due(self) -> int | None:
        return min((heard + self.idle for _, heard, active in self.streams.values() if active), default=None) if self.idle is not None else None

    def _pop(self, now: int, detail: str | None = None) -> Event:
        ts, _, _, size, per, message = heapq.heappop(self.held)
        self.bytes -= size
        self.last = ts if self.last is None else max(self.last, ts)
        if per is not None:
            self.last_per[per] = max(self.last_per.get(per, ts), ts)
        return "released", message, now, detail

    def _release(self, now: int) -> Iterator[Event]:
        tops = [top for top, _, active in self.streams.values() if active]
        if tops:
            self.watermark = min(tops) - self.lateness
        while self.held and self.watermark is not None and self.held[0][0] <= self.watermark:
            yield self._pop(now)
        if self.bytes > self.most_bytes:
            yield "overflow", None, now, f"{self.bytes} bytes"
            while self.held and self.bytes > self.most_bytes:
                yield self._pop(now, "early")

    def fire(self, now: int) -> Iterator[Event]:
        for s in self.streams.values():
            if s[2] and now - s[1] >= self.idle:
                s[2] = False
        yield from self._release(now)

    def offer(self, stream, ts: int, arrival: int, size: int, per, message, now: int) -> Iterator[Event]:
        while (due := self.due()) is not None and due <= now:
            yield from self.fire(due)
        top = self.streams[stream][0] if stream in self.streams else ts
        self.streams[stream] = [max(top, ts), now, True]
        last = self.last_per.get(per) if self.per_key and per is not None else self.last
        if last is not None and ts < last:
            yield self.on_late, message, now, None
        else:
            heapq.heappush(self.held, (ts, stream, arrival, size, per, message))
            self.bytes += size
        yield from self._release(now)


def sequenced_ports(df: DataFrame, key: str, seq: str, arrival: str, clock: str, gap: int | None = None, size: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, seq, arrival, outcome, at, detail): what each key's sequenced port does with its rows, in the order of ``arrival``.

    outcome is released, duplicate, replaced, skipped or overflow; the last two are reports without number and arrival. at is a
    time of the column ``clock``, which rises with ``arrival``.  After the last arrival the timers run on until nothing is held; without
    ``gap`` what is held then has no row.  A null key is a key; rows without number, arrival or clock take no part.

    What a port skips depends on all it has skipped before, so a key's rows go through one task in order; the task keeps
    the port, which holds ``most_bytes`` at most, and no other rows.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = [key, seq, arrival, clock, *([size] if size else [])]

    def run(batches):
        port, current, begun = None, None, False

        def rows(events):
            return [(current, *(m if m is not None else (None, None)), o, t, d) for o, m, t, d in events]

        def ended():
            out = []
            while port is not None and (due := port.due()) is not None:
                out += rows(port.fire(due))
            return out

        def batch_of(out):
            cols = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        names, types = ["key", "seq", "arrival", "outcome", "at", "detail"], None
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            out = []
            for k, n, a, c, *more in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or k != current:
                    out += ended()
                    port, current, begun = SequencedPort(gap, most_bytes), k, True
                out += rows(port.offer(n, (more[0] or 0) if more else 0, (n, a), c))
            yield batch_of(out)
        if begun:
            yield batch_of(ended())

    src = df.select(*[df[c] for c in columns[:1]], *[df[c].cast("long").alias(f"_{k}") for k, c in enumerate(columns[1:])]).where("_0 is not null and _1 is not null and _2 is not null")
    ordered = src.repartition(key).sortWithinPartitions(key, "_1")
    return ordered.mapInArrow(run, f"key {kind}, seq long, arrival long, outcome string, at long, detail string").withColumnRenamed("key", key)
