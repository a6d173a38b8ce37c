"""Ports with timers against plain loops over all events, in batch and in streams."""

import random
import time

import pytest

from labelflow.operators.ports import OrderedPort, SequencedPort, sequenced_ports
from labelflow.streaming import ports


def walk(rows, gap):
    """[(seq, arrival, outcome, at)] of one sequenced port, clock by clock."""
    out, held, nxt, since, rows = [], {}, 0, None, sorted(rows, key=lambda r: r[1])

    def drain(now):
        nonlocal nxt, since
        while nxt in held:
            out.append((nxt, held.pop(nxt), "released", now))
            nxt += 1
        if not held:
            since = None

    i = 0
    for now in range(0, 4000):
        if gap is not None and since is not None and now - since >= gap and held:
            out.append((None, None, "skipped", now))
            nxt = min(held)
            drain(now)
            since = now if held else None
        while i < len(rows) and rows[i][2] == now:
            n, a, _ = rows[i]
            i += 1
            if n < nxt:
                out.append((n, a, "duplicate", now))
                continue
            if n in held:
                out.append((n, held[n], "replaced", now))
            held[n] = a
            drain(now)
            if held and since is None:
                since = now
    return out


@pytest.mark.parametrize("gap", [None, 1, 7, 40])
def test_sequenced_ports_equal_a_loop(spark, gap):
    rng, rows = random.Random(gap), []
    for k in ("x", "y", None):
        clock = 0
        for a in range(120):
            clock += rng.choice([0, 0, 1, 3, 20])
            rows.append((k, max(0, a + rng.randint(-6, 6) + a // 15), a, clock))
    df = spark.createDataFrame([*rows, ("x", None, 1000, 5000)], "k string, n int, a long, c long").repartition(3)
    got = sequenced_ports(df, "k", "n", "a", "c", gap).collect()
    for k in ("x", "y", None):
        mine = sorted(((r["seq"], r["arrival"], r["outcome"], r["at"]) for r in got if r["k"] == k), key=str)
        assert mine == sorted(walk([r[1:] for r in rows if r[0] == k], gap), key=str)
    assert sequenced_ports(df.where("false"), "k", "n", "a", "c", gap).collect() == []


def test_sequenced_port_overflow():
    port = SequencedPort(most_bytes=10)
    got = [[(o, m, d) for o, m, _, d in port.offer(n, 6, n, 0)] for n in (3, 4, 1)]
    assert got == [[], [("overflow", None, "12 bytes"), ("skipped", None, "0..2"), ("released", 3, None), ("released", 4, None)], [("duplicate", 1, None)]] and port.bytes == 0


def merged(rows, lateness, idle, most):
    """[(arrival, outcome, at)] of one ordered port by a loop over times and a sorted list."""
    out, held, streams, w, last, i = [], [], {}, None, None, 0
    rows = sorted(rows)

    def release(now):
        nonlocal w, last
        active = [s for s in streams.values() if s["on"]]
        w = min(s["top"] for s in active) - lateness if active else w
        held.sort()
        while held and ((w is not None and held[0][0] <= w) or sum(h[3] for h in held) > most):
            t, _, a, _ = held.pop(0)
            last = t if last is None or t > last else last
            out.append((a, "released", now))

    for now in range(0, 3000):
        if idle is not None and any(s["on"] and now - s["heard"] >= idle for s in streams.values()):
            for s in streams.values():
                s["on"] = s["on"] and now - s["heard"] < idle
            release(now)
        while i < len(rows) and rows[i][1] == now:
            a, _, s, t, size = rows[i]
            i += 1
            old = streams.get(s, {"top": t})["top"]
            streams[s] = {"top": max(old, t), "heard": now, "on": True}
            if last is not None and t < last:
                out.append((a, "routed", now))
            else:
                held.append((t, s, a, size))
            release(now)
    return out


@pytest.mark.parametrize("lateness,idle,most", [(0, None, 10**9), (5, 12, 10**9), (30, 4, 60), (10**6, None, 45)])
def test_ordered_port_equals_a_loop(lateness, idle, most):
    rng = random.Random(most)
    for _ in range(40):
        clock, rows = 0, []
        for a in range(80):
            clock += rng.choice([0, 1, 2, 15])
            rows.append((a, clock, rng.choice("pqr"), clock + rng.randint(-20, 20), rng.randint(0, 20)))
        port, got = OrderedPort(lateness, idle, most, "routed"), []
        for a, now, s, t, size in rows:
            got += port.offer(s, t, a, size, None, a, now)
        while (due := port.due()) is not None:
            got += port.fire(due)
        assert [(m, o, at) for o, m, at, _ in got if o != "overflow"] == merged(rows, lateness, idle, most)
        assert most == 10**9 or any(o == "overflow" for o, *_ in got)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ports.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def in_batches(spark, tmp_path, name, schema, parts, build, mode="append", until=None):
    """Rows of a query over files that arrive one by one; ``until`` waits, on processing time, for so many rows (its batches never end)."""
    src = tmp_path / f"{name}-in"
    src.mkdir()
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(processingTime="200 milliseconds").start()
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"{name}-{k}"))
            [f] = (tmp_path / f"{name}-{k}").glob("part-*")
            f.rename(src / f"{k}.json")
            if until is None:
                q.processAllAvailable()
        end = time.time() + 90
        while until is not None and spark.table(name).count() < until and time.time() < end:
            time.sleep(0.3)
        return spark.table(name).collect()
    finally:
        q.stop()


def test_sequenced_stream_skips_by_timer(rocks, tmp_path):
    parts = [[("x", 0, 0), ("x", 2, 1), ("y", 0, 2), ("x", 3, 3), ("x", 2, 4), ("y", 2, 5)]]
    rows = in_batches(rocks, tmp_path, "seqs", "k string, n long, a long", parts, lambda s: ports.sequenced_port(s, "k", "n", "a", gap_ms=3000), until=8)
    got = [(r["k"], r["n"], r["a"], r["outcome"], r["detail"]) for r in rows]
    assert sorted(got, key=str) == sorted([("x", 0, 0, "released", None), ("y", 0, 2, "released", None), ("x", 2, 1, "replaced", None), ("x", None, None, "skipped", "1..1"), ("x", 2, 4, "released", None), ("x", 3, 3, "released", None), ("y", None, None, "skipped", "1..1"), ("y", 2, 5, "released", None)], key=str)  # no data came when the timers fired


def test_idle_stream_frees_a_port_while_another_sends(rocks, tmp_path):
    parts = [[("m", "quiet", 0, 10), ("m", "busy", 1, 50)], [("m", "busy", 2, 60)]]
    rows = in_batches(rocks, tmp_path, "idle", "p string, s string, a long, t long", parts, lambda s: ports.ordered_port(s, "p", "s", "a", "t", idle_ms=4000), until=3)
    assert [(r["a"], r["outcome"]) for r in rows] == [(0, "released"), (1, "released"), (2, "released")]


def test_buffer_bound_does_not_depend_on_micro_batches(rocks, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("mn"), rng.choice("pq"), a, rng.randint(0, 200), rng.randint(1, 30), rng.choice([None, "u", "v"])) for a in range(60)]
    want = []
    for p in "mn":
        port = OrderedPort(lateness=10**6, most_bytes=90, on_late="late", per_key=True)
        for q, s, a, t, size, per in rows:
            want += [(p, m[2] if m else None, o, d) for o, m, _, d in port.offer(s, t, a, size, per, (q, s, a), 0)] if q == p else []
    schema = "p string, s string, a long, t long, b long, per string"
    cuts = [0, 1, 7, 20, 22, 45, 60]
    got = in_batches(rocks, tmp_path, "bound", schema, [rows[i:j] for i, j in zip(cuts, cuts[1:])], lambda s: ports.ordered_port(s, "p", "s", "a", "t", lateness=10**6, on_late="late", per="per", size="b", most_bytes=90), until=len(want))
    assert sorted(((r["p"], r["a"], r["outcome"], r["detail"]) for r in got), key=str) == sorted(want, key=str) and any(o == "late" for *_, o, _ in want)


def test_slice_averages_by_ticks(rocks, tmp_path):
    parts = [[("x", 0, 1.0), ("x", 30, 3.0), ("x", 60, 5.0)], [("x", 61, 7.0), ("y", 5, None)]]
    rows = in_batches(rocks, tmp_path, "ticks", "k string, ts long, v double", parts, lambda s: ports.slice_averages(s, "k", "ts", "v", 60, tick_ms=1500), "update", until=2)
    assert {(r["k"], r["slice"]): (r["avg_value"], r["n"]) for r in rows} == {("x", 0): (2.0, 2), ("x", 1): (6.0, 2)}


def test_registry_stream_from_a_snapshot(rocks, tmp_path):
    snapshot = rocks.createDataFrame([("a", 5, 1.0), ("b", 3, 2.0)], "k string, n long, v double")
    parts = [[("a", 4, "set", 0.5), ("a", 6, "set", 9.0), ("b", 3, "set", 2.0), ("c", 1, "set", 4.0)], [("a", 6, "set", 9.0), ("b", 7, "delete", None), ("c", 1, "set", 4.0)]]
    rows = in_batches(rocks, tmp_path, "registry", "k string, n long, op string, v double", parts, lambda s: ports.registry_stream(s, snapshot, "k", "n", "op", "v"))
    assert sorted((r["k"], r["n"], r["op"]) for r in rows) == [("a", 6, "set"), ("b", 7, "delete"), ("c", 1, "set")]
