"""Event-time windows: change log, medians, slices, forecast, state changes, sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators.ranks import by_groups, kth_smallest, medians
from labelflow.tables import first_reaching, running, time_slices, written

#: Rows of a part of a slice of ``time_medians``, about.
PART = 1 << 19


def window_changelog(df: DataFrame, time: str = "ts", length: int = 3600, order: str = "seq") -> DataFrame:
    """Add and Remove rows of a sliding window (t - length, t], with ``by``: the arrival that causes the move.

    The greatest time seen drives the window.  Rows leave in the order they came, so a row goes, right before an arrival
    is added, once that arrival's time is ``length`` beyond the greatest time up to the row itself.  Moves
    happen in the order of by, then Remove before Add, then ``order``.  Rows that nothing drives out stay.
    """
    top = running(df, order, _top=("max", F.col(time)))
    levels = top.select(F.col(order).alias("_at"), F.col("_top").alias("_level"))
    gone = first_reaching(levels, top.select(*df.columns, (F.col("_top") + length).alias("_want")))
    gone = gone.where("_first is not null").select(*df.columns, F.lit("Remove").alias("action"), F.col("_first").alias("by"))
    return df.withColumn("action", F.lit("Add")).withColumn("by", F.col(order).cast("long")).unionByName(gone)


def _medians(df: DataFrame, keys: tuple, time: str, order: list[str], value: str, length: int, name: str, first_only: bool) -> DataFrame:
    """``df`` with the median of ``value`` over (t - length, t] of its key; whole windows lie in a row's time slice."""
    s = time_slices(df, time, length)
    parts = [*keys, "_slice"]

    def work(t: pa.Table, group: np.ndarray) -> pa.Table:
        at = t.column(time).to_numpy()
        low = int(at.min())
        line = group * (2 * (int(at.max()) - low) + 2 * length + 2) + (at - low)  # groups far apart on one line
        from_row = np.searchsorted(line, line - length, side="right")
        first = np.searchsorted(line, line, side="left")
        upto = first + 1 if first_only else np.searchsorted(line, line, side="right")
        valid = t.column(value).is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(valid)])
        values = t.column(value).filter(pa.array(valid)).to_numpy().astype(np.float64)
        want = t.column("_own").to_numpy()
        if first_only:
            want = want & (first == np.arange(len(at)))
        rows = np.flatnonzero(want)
        found = medians(values, before[from_row[rows]], before[upto[rows]])
        out = t.take(pa.array(rows)).drop_columns(["_slice", "_own"])
        return out.append_column(name, pa.array(found, mask=np.isnan(found)))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` double"
    return by_groups(s, parts, [time, *order], work, kind)


def sliding_median(df: DataFrame, keys: tuple = (), time: str = "ts", value: str = "value", length: int = 3600, name: str = "median") -> DataFrame:
    """``df`` with the exact median of ``value`` over the rows of its key in (t - length, t], later rows of t included.

    Times are whole numbers; null values do not count.
    """
    return _medians(df, keys, time, [], value, length, name, False)


def time_medians(df: DataFrame, time: str = "ts", value: str = "value", length: int = 3600, name: str = "median", part: int = PART) -> DataFrame:
    """(time, name): for each time t of ``df`` the exact median of ``value`` over all rows in (t - length, t].

    A task holds about ``part`` rows and a slice's times, however many rows a window has: the rows of a slice are parted by value; each
    part counts its rows in every window, the counts name the parts that have the middle two, and those are asked
    for them.  Times are whole numbers; null values do not count; a window without values has a null.
    """
    s = time_slices(df.select(F.col(time).cast("long").alias("t"), F.col(value).cast("double").alias("v")), "t", length)
    asks = written(s.where("_own").select("_slice", "t").distinct())
    rows = s.where("v is not null").select("_slice", "t", "v")
    parts = max(1, -(-rows.count() // part))
    rows = written(rows.repartitionByRange(parts, "_slice", "v", "t").withColumn("_part", F.spark_partition_id()))
    pieces = rows.select(F.col("_slice").alias("_s"), F.col("_part").alias("_p")).distinct()  # a row per slice and part

    def ranges(asked: pa.Table, held: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = held.column("t").to_numpy()
        order = np.argsort(at, kind="stable")
        at, want = at[order], asked.column("t").to_numpy()
        return order, want, np.searchsorted(at, want - length, side="right"), np.searchsorted(at, want, side="right")

    def count(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        _, want, lo, hi = ranges(asked, held)
        some = hi > lo
        return pa.table({"t": want[some], "_part": np.full(some.sum(), key[1].as_py(), np.int32), "n": (hi - lo)[some], "_slice": np.full(some.sum(), key[0].as_py())})

    def pick(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        order, want, lo, hi = ranges(asked, held)
        values, out = held.column("v").to_numpy()[order], np.zeros(len(want))
        for end in ("low", "high"):
            k = asked.column(end).to_numpy()
            here = (k >= 0) & (k < hi - lo)
            out[here] += kth_smallest(values, lo[here], hi[here], k[here])
        return pa.table({"t": want, "half": out / 2})

    by_piece = rows.groupBy("_slice", "_part")
    counts = asks.join(F.broadcast(pieces), F.col("_slice") == F.col("_s")).select("_slice", "_p", "t").groupBy("_slice", "_p").cogroup(by_piece).applyInArrow(count, "t long, _part int, n long, _slice long")
    window = Window.partitionBy("t")
    before, total = F.sum("n").over(window.orderBy("_part")) - F.col("n"), F.sum("n").over(window)
    found = counts.select("_slice", "_part", "t", "n", ((total - 1) / 2).cast("long").alias("low"), (total / 2).cast("long").alias("high"), before.alias("before"))
    found = found.withColumns({"low": F.col("low") - F.col("before"), "high": F.col("high") - F.col("before")}).where("low between 0 and n - 1 or high between 0 and n - 1")
    halves = found.select("_slice", "_part", "t", "low", "high").groupBy("_slice", "_part").cogroup(by_piece).applyInArrow(pick, "t long, half double")
    middle = halves.groupBy("t").agg(F.sum("half").alias(name))
    return asks.select("t").join(middle, "t", "left").select(F.col("t").alias(time), name)


def first_reading_median(df: DataFrame, keys: tuple = (), time: str = "ts", order: str = "seq", value: str = "value", length: int = 3600, name: str = "median") -> DataFrame:
    """One row per key and time: the median over earlier rows of the window and the time's first row only."""
    return _medians(df, keys, time, [order], value, length, name, True).select(*keys, time, order, name)


def outlier_changes(plug_medians: DataFrame, global_medians: DataFrame, per_house: bool = True, day: int = 86400) -> DataFrame:
    """Where a plug's median crosses the global one: share of its group's plugs that are outliers then.

    plug_medians: house, plug, ts, seq, plug_median; global_medians: ts, global_median.
    A group is a house, or all houses together with ``per_house`` off.
    """
    j = plug_medians.join(global_medians.select("ts", "global_median"), "ts")
    j = j.withColumn("grp", F.col("house") if per_house else F.lit(0))
    j = j.withColumn("flag", F.col("global_median") < F.col("plug_median"))
    plug = Window.partitionBy("grp", "house", "plug").orderBy("seq")
    j = j.withColumn("was", F.lag("flag", 1, False).over(plug)).withColumn("fresh", F.row_number().over(plug) == 1)
    step = F.when(F.col("flag") & ~F.col("was"), 1).when(~F.col("flag") & F.col("was"), -1).otherwise(0)
    j = running(j, "seq", ("grp",), members=("count", F.when(F.col("fresh"), 1)), outliers=("sum", step))
    j = j.where("flag <> was")
    return j.select((F.col("ts") - day).alias("window_start"), F.col("ts").alias("window_end"), "house", "plug", "seq", (F.col("outliers") / F.col("members")).alias("share"))


def slice_number(time: str, start: Column, width: int = 60) -> Column:
    """The slice (start + width * k, start + width * (k + 1)] of a time; the start itself is in slice 0."""
    return F.greatest(F.lit(0), F.ceil((F.col(time) - start) / width) - 1).cast("long")


def slice_averages(df: DataFrame, keys: tuple, time: str = "ts", value: str = "value", width: int = 60) -> DataFrame:
    """(keys, slice, slice_start, avg_value, n) of tumbling slices that start at each key's first time."""
    first = df.groupBy(*keys).agg(F.min(time).alias("t0"))
    s = df.join(first, list(keys)).withColumn("slice", slice_number(time, F.col("t0"), width))
    out = s.groupBy(*keys, "slice").agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("n"), F.min("t0").alias("t0"))
    return out.select(*keys, "slice", (F.col("t0") + F.col("slice") * width).alias("slice_start"), "avg_value", "n")


def load_forecast(averages: DataFrame, keys: tuple, width: int = 60, per_day: int = 1440) -> DataFrame:
    """(keys, slice, for_time, predicted): current average plus the median of the target's time of day before.

    The target is two slices on; its history are the slices a whole number of days before slice + 1, the key's first one not counted.
    """
    past = averages.select(*keys, F.col("slice").alias("old"), F.col("avg_value").alias("old_avg")).where("old > 0").withColumn("phase", F.col("old") % per_day)
    now = averages.withColumn("phase", (F.col("slice") + 1) % per_day)
    hist = now.select(*keys, "slice", "phase").join(past, [*keys, "phase"]).where(F.col("old") <= F.col("slice") + 1 - per_day).groupBy(*keys, "slice").agg(F.percentile("old_avg", 0.5).alias("usual"))
    out = now.join(hist, [*keys, "slice"], "left")
    return out.select(*keys, "slice", (F.col("slice_start") + 2 * width).alias("for_time"), (F.col("avg_value") + F.coalesce("usual", F.lit(0.0))).alias("predicted"))


def transition_model(df: DataFrame, entity: str = "entity_id", order: str = "seq", state: str = "state") -> DataFrame:
    """(prev, cur, p): how often each state follows another within an entity; rows of a prev sum to 1."""
    prev = F.lag(state).over(Window.partitionBy(entity).orderBy(order))
    n = df.select(prev.alias("prev"), F.col(state).alias("cur")).where("prev is not null").groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("prev").agg(F.sum("n").alias("total"))
    return n.join(total, "prev").select("prev", "cur", (F.col("n") / F.col("total")).alias("p"))


def sequence_scores(df: DataFrame, model: DataFrame, algorithm: str = "missProbability", threshold: float = 0.96, entity: str = "entity_id", order: str = "seq", state: str = "state") -> DataFrame:
    """``df`` with states, score and outlier: how unusual the last five states of an entity are.

    missProbability: mean of 1 - p over the four transitions.  missRate: share of transitions that do
    not go to the previous state's likeliest next one (the first in order among equals).  entropyReduction:
    mean of 1 - p weighted by 1 / (1 + entropy) of the previous state.  Fewer than five records score 0; an
    unknown previous state gives a null score, an unknown transition p = 0.
    The model has a row per pair of states, a bounded number.
    """
    steps = model.groupBy("prev").agg(F.map_from_entries(F.collect_list(F.struct("cur", "p"))).alias("next"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.min_by("cur", F.struct(-F.col("p"), "cur")).alias("best"))
    table = steps.agg(F.map_from_entries(F.collect_list(F.struct("prev", F.struct("next", "entropy", "best")))).alias("m"))
    last5 = F.collect_list(state).over(Window.partitionBy(entity).orderBy(order).rowsBetween(-4, 0))
    d = df.withColumn("_s", last5).crossJoin(F.broadcast(table))  # one row
    pairs = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.element_at("_s", i).alias("a"), F.element_at("_s", i + 1).alias("b")))
    p = lambda q: F.when(F.element_at("m", q["a"]).isNotNull(), F.coalesce(F.element_at(F.element_at("m", q["a"])["next"], q["b"]), F.lit(0.0)))
    term = {
        "missProbability": lambda q: 1 - p(q),
        "missRate": lambda q: F.when(F.element_at("m", q["a"])["best"] == q["b"], 0.0).when(F.element_at("m", q["a"]).isNotNull(), 1.0),
        "entropyReduction": lambda q: (1 - p(q)) / (1 + F.element_at("m", q["a"])["entropy"]),
    }[algorithm]
    score = F.aggregate(F.transform(pairs, term), F.lit(0.0), lambda s, v: s + v) / 4
    d = d.withColumn("score", F.when(F.size("_s") == 5, score).otherwise(F.lit(0.0)))
    d = d.withColumn("states", F.when(F.size("_s") == 5, F.array_join("_s", ",")).otherwise(""))
    return d.withColumn("outlier", F.coalesce(F.col("score") > threshold, F.lit(False))).drop("_s", "m")


def fall_events(frames: DataFrame, every: int = 45, order: str = "seq") -> DataFrame:
    """Each frame with patient_id and fall: every ``every``-th frame of all is a fall."""
    n = running(frames, order, frame_no=("count", F.lit(1)))
    return n.withColumn("patient_id", F.coalesce(F.nullif(F.col("person"), F.lit("")), F.lit("unknown"))).withColumn("fall", F.col("frame_no") % every == 0)


def risk(fall: Column, heart_rate: Column, spo2: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(fall), "high").when(yes(heart_rate > 95) | yes(spo2 < 95), "elevated").otherwise("normal")
