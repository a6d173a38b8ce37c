"""Ordering operators against naive models on random input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.operators import ordering as od


def naive_merge(rows, lateness, idle=None, per=False):
    """The definition, arrival by arrival: rows (arrival, stream, t, clock, key) -> {arrival: (released_at, late)}."""
    level, tops, seen = [], {}, {}
    for _, s, t, c, _ in rows:
        tops[s], seen[s] = max(t, tops.get(s, t)), c
        level.append(min(v for k, v in tops.items() if idle is None or k == s or c - seen[k] < idle) - lateness)
    out = {}
    for i, (a, _, t, _, _) in enumerate(rows):
        out[a] = next((rows[j][0] for j in range(i, len(rows)) if level[j] >= t), None)
    return {a: (out[a], any(out[b] is not None and out[b] < a and u > t and (not per or k == g) for b, _, u, _, g in rows)) for a, _, t, _, k in rows}


def random_rows(rng, n, streams):
    clock, rows = 0, []
    for a in range(n):
        clock += rng.choice([1, 1, 2, 30])
        s = rng.randrange(streams) if a > n // 4 else rng.randrange(max(1, streams - 1))  # the last stream shows up later
        rows.append((a * 40000, s, rng.randint(-25, 25) + a // 2, clock, rng.randrange(3)))
    return rows


@pytest.mark.parametrize("streams,lateness,idle,per", [(1, 6, None, False), (3, 4, None, False), (3, 0, 45, False), (2, 3, None, True)])
def test_merge_equals_the_definition(spark, streams, lateness, idle, per):
    rng = random.Random(streams * 10 + lateness)
    ports = {p: random_rows(rng, 150, streams) for p in ("x", None)}
    d = spark.createDataFrame([(p, *r) for p, rows in ports.items() for r in rows], "port string, a long, s int, t long, c long, k int")
    got = od.ordered_merge(d, "port", "s", tuple(range(streams)), "a", "t", lateness, "pass", "k" if per else None, idle, "c" if idle else None).collect()
    assert len(got) == 300
    for p, rows in ports.items():
        want = naive_merge(rows, lateness, idle, per)
        mine = {r["a"]: ((r["emitted_at"] if r["outcome"] == "released" else want[r["a"]][0]), r["outcome"] == "late") for r in got if r["port"] == p}
        assert mine == want and any(late for _, late in want.values())


@pytest.mark.parametrize("mode", ["drop", "pass", "route"])
def test_late_messages_and_order(spark, mode):
    rng = random.Random(8)
    rows = random_rows(rng, 120, 2)
    want = naive_merge(rows, 5)
    d = spark.createDataFrame([(0, *r) for r in rows], "port int, a long, s int, t long, c long, k int")
    m = od.ordered_merge(d, "port", "s", (0, 1), "a", "t", 5, mode)
    names = {"drop": "dropped", "pass": "late", "route": "routed"}
    assert {r["a"]: r["outcome"] for r in m.collect()} == {a: names[mode] if late else "released" for a, (_, late) in want.items()}
    order = []
    for a, s, t, _, _ in rows:
        released, late = want[a]
        if not late or mode != "drop":
            order.append(((a if late else released if released is not None else 10**12), not late, t, s, a))
    got = [r["a"] for r in od.in_order(m, "port", "s", "a", "t").orderBy("position").collect()]
    assert got == [x[-1] for x in sorted(order)]


def test_plan_pairs_no_messages(spark):
    d = spark.range(10).selectExpr("null as port", "id as a", "id as t")
    plan = od.late_single_stream(d.selectExpr("cast(port as int) port", "a", "t"), "port", "a", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan and "Cartesian" not in plan


def test_micro_batches_equal_one_batch():
    rng = random.Random(3)
    rows = random_rows(rng, 200, 3)
    want = naive_merge(rows, 4)
    tops, last, held, got = {}, None, np.zeros(0, np.int64), {}
    names = np.zeros(0, np.int64)
    for lo in range(0, 200, 23):
        part = rows[lo : lo + 23]
        s, t = np.array([r[1] for r in part]), np.array([r[2] for r in part])
        at, late, tops, last = od.merge_arrays(s, t, held, tops, last, 4)
        ids = np.concatenate([names, [r[0] for r in part]]).astype(np.int64)
        got |= {int(i): part[k][0] for i, k in zip(ids, at) if k >= 0}
        assert [bool(x) for x in late] == [want[r[0]][1] for r in part]
        names, held = ids[at < 0], np.concatenate([held, t])[at < 0]
    assert got == {a: r for a, (r, _) in want.items() if r is not None}


def test_streaming_twins(spark, tmp_path):
    from labelflow.streaming import stateful as st

    d = spark.range(60).select(F.col("id").alias("a"), (F.col("id") % 2).alias("port"), (F.col("id") % 3).cast("int").alias("s"), (F.col("id") * 7 % 11 + F.col("id")).alias("t"), F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 20 + 86400).alias("at"))
    for k in range(3):
        d.where(f"a div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs = {
        "total": (st.running_sum(stream, "port", "v", "a"), "append"), "merge": (st.ordered_merge(stream, "port", "s", "a", "t", 4, "route"), "append"),
        "small": (st.ordered_merge(stream, "port", "s", "a", "t", 10**6, most_held=5), "append"), "latest": (st.latest_per_key(stream, "port", "a"), "complete"),
        "averages": (st.window_averages(stream, "at", ("port",), "v", delay="1 minute"), "append"),
        "medians": (st.median_join(stream.select("port", F.col("at").alias("ts"), "v"), stream.where("port = 0").select(F.col("at").alias("ts"), F.col("v").alias("g"))), "append")}
    for name, (df, mode) in runs.items():
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(180)
    last = {r["port"]: r["t"] for r in spark.sql("select port, max(total) t from total group by port").collect()}
    assert last == {p: float(sum(i for i in range(60) if i % 2 == p)) for p in (0, 1)}
    batch = {(r["port"], r["a"]): r["outcome"] for r in od.ordered_merge(d, "port", "s", (0, 1, 2), "a", "t", 4, "route").where("emitted_at is not null").collect()}
    assert {(r["port"], r["a"]): r["outcome"] for r in spark.sql("select * from merge").collect()} == batch
    assert spark.sql("select * from small").count() == 60 - 2 * 5
    assert {(r["port"], r["latest"]["a"], r["served"]) for r in spark.sql("select * from latest").collect()} == {(0, 58, 30), (1, 59, 30)}
    done = {(r["start"].timestamp(), r["port"]): (r["avg_value"], r["n"]) for r in spark.sql("select * from averages").collect()}
    first = min(t for t, _ in done)
    assert done[first, 0] == (1.0, 2) and done[first, 1] == (1.0, 1)
    assert {r["v"] for r in spark.sql("select * from medians where port = 0").collect()} <= {float(i) for i in range(0, 60, 2)} and spark.sql("select * from medians").count() == 30


def test_sliding_medians_equal_sorted_windows(spark):
    import statistics

    from labelflow.operators import windows as wd

    rng = random.Random(12)
    rows = [(i, rng.randint(0, 900), rng.choice([None, *map(float, range(40))]), rng.choice(["p", "q", None])) for i in range(700)]
    d = spark.createDataFrame(rows, "seq long, ts long, value double, k string")
    mid = lambda v: statistics.median(v) if v else None
    got = {r["seq"]: r["median"] for r in wd.sliding_median(d, ("k",), length=60).collect()}
    assert got == {i: mid([v for _, u, v, g in rows if g == k and t - 60 < u <= t and v is not None]) for i, t, _, k in rows}
    first = {(r["ts"], r["seq"]): r["median"] for r in wd.first_reading_median(d, (), length=60).collect()}
    want = {}
    for i, t, v, _ in rows:
        if i == min(j for j, u, _, _ in rows if u == t):
            want[t, i] = mid([w for j, u, w, _ in rows if (t - 60 < u < t or j == i) and w is not None])
    assert first == want
    assert wd.sliding_median(d.limit(0), ("k",)).collect() == []


def test_time_medians_of_windows_larger_than_a_part(spark):
    import statistics

    from labelflow.operators import windows as wd

    rng = random.Random(13)
    rows = [(rng.randint(-300, 900), rng.choice([None, 7.0, 7.0, *map(float, range(20))])) for _ in range(900)] + [(5000, None), (9000, 1.5)]
    d = spark.createDataFrame(rows, "ts long, value double")
    want = {t: [v for u, v in rows if t - 200 < u <= t and v is not None] for t, _ in rows}
    want = {t: statistics.median(v) if v else None for t, v in want.items()}
    for part in (20, 150, 10_000):  # a window has 150 rows or so
        got = wd.time_medians(d, length=200, part=part).collect()
        assert {r["ts"]: r["median"] for r in got} == want and len(got) == len(want)
    assert wd.time_medians(d.limit(0)).collect() == []


def test_downsample_equals_the_sampler(spark):
    from labelflow.operators import metrics as mt

    rng = random.Random(6)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([0, 10, 50, 90, 700])
        rows.append((0, i, t))
    got = sorted(r["i"] for r in mt.downsample(spark.createDataFrame(rows, "k int, i long, t long"), ("k",), "t", "i", 200).collect())
    want, at = [], 0
    for _, i, t in rows:
        if at <= t - rows[0][2]:
            want.append(i)
            at += 200
    assert got == want


def test_sequence_release(spark):
    rows = [("x", 1, 0), ("x", 0, 1), ("x", 3, 2), ("x", 1, 3), ("y", 0, 4)]
    got = {(r["k"], r["s"]): r["released_at"] for r in od.sequence_release(spark.createDataFrame(rows, "k string, s long, a long"), "k", "s", "a").collect()}
    assert got == {("x", 0): 1, ("x", 1): 1, ("x", 3): None, ("y", 0): 4}


def test_whole_groups_of_any_length(monkeypatch):
    import time

    import numpy as np
    import pyarrow as pa

    from labelflow.operators import ranks

    rng = np.random.default_rng(2)
    monkeypatch.setattr(ranks, "CHUNK", 50)
    for sizes in ([400], [1] * 200, [1, 300, 1], [49, 1, 50, 7], rng.integers(1, 90, 40).tolist(), []):
        k = np.repeat(np.arange(len(sizes)) // 3, sizes)
        s = np.repeat([f"s{x}" for x in range(len(sizes))], sizes).astype(object)
        rows = pa.table({"k": k, "s": pa.array(s, pa.string()), "row": np.arange(len(k))})
        for step in (1, 7, 64):
            parts = list(ranks.whole_groups(iter(rows.to_batches(max_chunksize=step)), ["k", "s"])) if len(k) else []
            assert sum((t.column("row").to_pylist() for t, _ in parts), []) == list(range(len(k)))
            seen = [(x, y) for t, _ in parts for x, y in dict.fromkeys(zip(t.column("k").to_pylist(), t.column("s").to_pylist()))]
            assert len(seen) == len(set(seen)) == len(sizes) and all((np.diff(g, prepend=0) >= 0).all() for _, g in parts)
    monkeypatch.setattr(ranks, "CHUNK", 10_000)
    took = []
    for n in (500_000, 2_000_000):  # one group
        batches = pa.table({"k": np.zeros(n, np.int64), "v": np.arange(n)}).to_batches(max_chunksize=5_000)
        began = time.time()
        assert [t.num_rows for t, _ in ranks.whole_groups(iter(batches), ["k"])] == [n]
        took.append(time.time() - began)
    assert took[1] < 10 * max(took[0], 0.05)
