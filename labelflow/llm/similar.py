"""From pairs that met in buckets to exact components of a similarity graph.

Shared by the document and the line operator.  Every link is confirmed on whole sets.

1. Stars: each member of a bucket is compared with one centre of it, first with the one that it meets in most
   buckets; components follow.
2. What is left are buckets with members in different components.  Their members are compared with the bucket's
   first member; then, in those that are still mixed, all whose signatures are near if the bucket is small; large ones get some more centres.
3. Where bitmaps of the sets are at hand, both of these are one step, in tasks that hold whole buckets: a bitmap rules out nearly all pairs that are
   not similar, and none that are.  All pairs of large buckets of up to MIDDLE members that are still mixed then are looked at by bitmaps, too; where
   the sets can be had in the task, they are confirmed there, and a bucket gives fewer links than it has members.
4. Members of large ones that are still in several components are joined by prefix filtering: with the elements of all sets in one order, rare ones
   first, two sets of similarity t share one of the first n - ceil(t * n) + 1 elements of the larger and the first
   n - ceil(2t / (1 + t) * n) + 1 of the smaller.  Elements that only one component has come first
   and lead to no pair.  These shared elements are buckets again: stars first, then the pairs.

So work grows with bucket memberships and with pairs that share a rare element, not with the square of a bucket or group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_LEAST, HOT_PARTS, Scratch, connected_components, extend_components, hot_keys, lookup
from .text import mix

#: In buckets of at most so many members all pairs across components are looked at; larger ones go by prefixes.
SMALL = 24
#: Signatures of two sets hold two bits of each of 30 minhashes.  At similarity 0.8 more than FAR of the 30 differ with a chance of
#: 5e-5; such pairs are left out.
FAR = 13
#: Words of 64 bits in a set's parity bitmap; with bitmaps, all pairs of mixed buckets of up to MIDDLE members are looked at.
WORDS, MIDDLE = 16, 2048
#: Bytes of payloads of a bucket whose pairs a task confirms by itself, and members whose sets it makes at once.
BUCKET_BYTES, AT_ONCE = 4 << 20, 256
#: Further centres that the members of a large bucket are compared with.
CENTRES = 3
#: Pairs of so many rows (4 MB) or fewer are broadcast.
FEW = 250_000


def near(a: str, b: str) -> Column:
    """Whether two signatures differ in FAR minhashes at most."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) <= FAR


def bitmaps(flat: np.ndarray, at: np.ndarray) -> pa.StructArray:
    """A parity bitmap of each set of ``flat`` (distinct well-mixed values) from ``at``: a bit is the parity of the elements that fall on it."""
    sets, bits = len(at) - 1, 64 * WORDS
    place = np.repeat(np.arange(sets) * bits, np.diff(at)) + (flat & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=sets * bits) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64).reshape(sets, WORDS)
    return pa.StructArray.from_arrays([pa.array(words[:, k]) for k in range(WORDS)], [f"w{k}" for k in range(WORDS)])


#: The type of ``bitmaps``.
BITMAP = "struct<" + ", ".join(f"w{k}: long" for k in range(WORDS)) + ">"


def fitting(percent: int, bits: bool) -> Column:
    """Whether sets of n and nd elements can be similar; if ``bits``, by their bitmaps bits and bd, too.

    Each bit in which bitmaps differ stands for an element at least that only one of the sets has, and similar sets have
    (n + nd) * (100 - percent) / (100 + percent) of these at most.  So no similar pair is left out.
    """
    fit = F.expr(f"100 * least(n, nd) >= {percent} * greatest(n, nd)")
    if not bits:
        return fit
    differ = " + ".join(f"bit_count(bits.w{k} ^ bd.w{k})" for k in range(WORDS))
    return fit & F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (n + nd)")


def first_centres(met: DataFrame) -> DataFrame:
    """(src, dst) of ``met`` (src, dst, times): for each member the centre that it meets most often, the likeliest to be similar."""
    return met.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("times"), "dst")).alias("dst"))


def deal(both: DataFrame, payload: DataFrame, pairs: DataFrame) -> DataFrame:
    """``both`` (src, dst, sx) with the payload of dst as sy; ``pairs`` is the written table of its (src, dst).

    A dst of many pairs is dealt to several tasks, its payload with it; both grow by fewer than HOT_PARTS rows in all.
    """
    y = payload.select(F.col("rep").alias("dst"), F.col("payload").alias("sy"))
    hot = hot_keys(pairs, "dst")
    if not hot:
        return both.hint("merge").join(y, "dst")
    share = max(HOT_LEAST, sum(n for _, n in hot) // HOT_PARTS)
    parts = F.broadcast(pairs.sparkSession.createDataFrame([(k, -(-n // share)) for k, n in hot], "dst long, parts long"))
    both = both.join(parts, "dst", "left").withColumn("salt", F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1)))).drop("parts")
    y = y.join(parts, "dst", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return both.hint("merge").join(y, ["dst", "salt"]).drop("salt")


def with_payloads(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """``pairs`` (src, dst), a written table, with both payloads as sx and sy.

    FEW pairs at most are broadcast, so that only the payloads they name are dealt out; more are dealt out themselves.
    """
    x = payload.select(F.col("rep").alias("src"), F.col("payload").alias("sx"))
    if pairs.counts["rows"] > FEW:
        return deal(x.hint("merge").join(pairs.select("src", "dst"), "src"), payload, pairs)
    ends = pairs.select(F.col("dst").alias("rep")).distinct()
    return deal(x.join(F.broadcast(pairs.select("src", "dst")), "src"), payload.join(F.broadcast(ends), "rep", "left_semi"), pairs)


def similar_sets(both: DataFrame, percent: int) -> DataFrame:
    """The (src, dst) of rows with sets sx and sy that have 100 * intersection >= percent * union."""
    common = F.size(F.array_intersect("sx", "sy")).cast("long")
    union = F.size("sx") + F.size("sy") - F.col("common")
    return both.select("src", "dst", "sx", "sy", common.alias("common")).where(100 * F.col("common") >= percent * union).select("src", "dst")


def confirm_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (src, dst) of ``pairs`` whose full sets (rep, n, payload) have 100 * intersection >= percent * union."""
    return similar_sets(with_payloads(pairs, sets), percent)


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with lab: the component of rep, or rep itself."""
    labels = comp.select(F.col("node").alias("rep"), F.col("component").alias("lab"))
    few = hasattr(comp, "counts") and comp.counts["rows"] <= FEW
    out = rows.join(F.broadcast(labels), "rep", "left") if few else rows.hint("merge").join(labels, "rep", "left")
    return out.withColumn("lab", F.coalesce("lab", "rep"))


def _mixed(scratch: Scratch, buckets: DataFrame, comp: DataFrame, sizes: DataFrame | None = None, hot: list | None = None) -> DataFrame:
    """The members of buckets (key, rep, sig, n) in several components, with lab and the bucket's size k; n, and bits if it has them, are from ``sizes`` if given."""
    hot = hot_keys(buckets, "key") if hot is None else hot
    member = _labelled(buckets.select("key", "rep", "sig", *[c for c in ("n", "bits") if sizes is None and c in buckets.columns]), comp)
    keys = member.groupBy("key").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("key", "k")
    out = lookup(member, ["key"], keys, "inner", hot)
    return scratch.save(out if sizes is None else out.hint("merge").join(sizes, "rep"), large=F.count_if(F.col("k") > SMALL), huge=F.count_if(F.col("k") > MIDDLE))


def _others(rows: DataFrame) -> list[Column]:
    """What ``rows`` tell of the other end of a pair."""
    return [F.col(c).alias(d) for c, d in (("rep", "dst"), ("n", "nd"), ("lab", "ld"), ("sig", "sd"), ("bits", "bd")) if c in rows.columns]


def _with_centres(rows: DataFrame, hot: list, percent: int, first: Column) -> DataFrame:
    """(src, dst): members of buckets with the bucket's member that is first, if in another component and possibly similar."""
    others = _others(rows)
    centre = rows.groupBy("key").agg(F.min(F.struct(first.alias("first"), *others)).alias("c")).select("key", "c.*").drop("first")
    star = lookup(rows.select("key", "rep", "n", "lab", "sig", *["bits"] * ("bits" in rows.columns)), ["key"], centre, "inner", hot)
    return star.where((F.col("lab") != F.col("ld")) & near("sig", "sd") & fitting(percent, "bits" in rows.columns)).select(F.col("rep").alias("src"), "dst")


def _stars(mixed: DataFrame, hot: list, percent: int) -> DataFrame:
    """(src, dst): members of mixed buckets with CENTRES of the bucket's members, if in another component and possibly similar."""
    out = None
    for turn in range(CENTRES):
        star = _with_centres(mixed, hot, percent, F.xxhash64("rep", F.lit(turn)))
        out = star if out is None else out.union(star)
    return out


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst): all near pairs of members of a bucket that are in different components and possibly similar."""
    pairs = rows.hint("merge").join(rows.select("key", *_others(rows)), "key").where("rep < dst and lab <> ld")
    return pairs.where(near("sig", "sd") & fitting(percent, "bits" in rows.columns)).select(F.col("rep").alias("src"), "dst")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def mixed_pairs(mixed: DataFrame, hot: list, percent: int) -> DataFrame:
    """(src, dst) across components to be confirmed, each once however many buckets it shares: all near pairs of small buckets, members of large ones with centres."""
    small, large = mixed.where(F.col("k") <= SMALL), mixed.where(F.col("k") > SMALL)
    return _all_pairs(small, percent).union(ordered(_stars(large, hot, percent))).distinct()


def _bucket_pairs(percent: int, centres: bool):
    """A task's buckets (key, rep, n, lab, sig, bits) -> (src, dst): near pairs of a bucket in different components and possibly similar.

    All of them; with ``centres``, in buckets of more than SMALL members only those with its first member and with CENTRES others.
    """

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        key, rep, n, lab, sig = (t.column(c).to_numpy() for c in ("key", "rep", "n", "lab", "sig"))
        bits = np.stack([x.to_numpy() for x in t.column("bits").combine_chunks().flatten()], 1)
        order = np.lexsort((rep, key))
        key, rep, n, lab, sig, bits = (c[order] for c in (key, rep, n.astype(np.int64), lab, sig.view(np.uint64), bits.view(np.uint64)))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        end, small = np.repeat(first + size, size), np.repeat(size <= SMALL, size)
        found, many = [], 0

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal many
            ok = lab[x] != lab[y]
            x, y = x[ok], y[ok]
            differ = sig[x] ^ sig[y]
            ok = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= FAR
            x, y = x[ok], y[ok]
            ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[ok], y[ok]
            ok = (100 + percent) * np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= (100 - percent) * (n[x] + n[y])
            if ok.any():
                found.append((np.minimum(rep[x], rep[y])[ok], np.maximum(rep[x], rep[y])[ok]))
                many += int(ok.sum())

        def taken() -> pa.RecordBatch:
            nonlocal many
            pairs = np.unique(np.stack([np.concatenate(c) for c in zip(*found)], 1), axis=0)
            found.clear()
            many = 0
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        at = np.flatnonzero(small)
        for d in range(1, SMALL):
            at = at[at + d < end[at]]
            for lo in range(0, len(at), 50_000):
                keep(at[lo : lo + 50_000], at[lo : lo + 50_000] + d)
                if many > 50_000:
                    yield taken()
        for lo, k in zip(first, size):
            if k <= SMALL:
                continue
            rows = np.arange(lo, lo + k)
            turns = [rows[0], *rows[np.argsort(mix(rep[rows].view(np.uint64)))[:CENTRES]]] if centres else rows[:-1]
            for i in turns:
                y = rows[rows != i] if centres else np.arange(i + 1, lo + k)
                keep(np.full(len(y), i), y)
                if many > 50_000:
                    yield taken()
        if many:
            yield taken()

    return run


def _by_bitmaps(mixed: DataFrame, percent: int, centres: bool) -> DataFrame:
    """(src, dst), each once, of ``mixed`` as ``_bucket_pairs`` finds them; in buckets of more than MIDDLE members those with centres."""
    rows = (mixed.where(F.col("k") <= MIDDLE) if mixed.counts["huge"] else mixed).select("key", "rep", "n", "lab", "sig", "bits")
    pairs = rows.repartition("key").mapInArrow(_bucket_pairs(percent, centres), "src long, dst long")
    if mixed.counts["huge"] and centres:
        huge, hot = mixed.where(F.col("k") > MIDDLE), hot_keys(mixed, "key")
        pairs = pairs.union(ordered(_with_centres(huge, hot, percent, F.col("rep")))).union(ordered(_stars(huge, hot, percent)))
    return pairs.distinct()


def _whole_buckets(batches):
    """Tables of one bucket each of rows sorted by key."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held else t
        key = t.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(lo, hi - lo)
        held = t.slice(cuts[-1])
    if held:
        yield held


def _bucket_links(percent: int, sets_of: Callable):
    """A task's buckets (key, rep, n, lab, sig, bits, payload), sorted by key -> (src, dst, open): a link of each two components that a similar pair of a bucket joins.

    ``sets_of`` a column of payloads is (elements, offsets).  Each pair is looked at unless links that are found already join it, so a bucket gives fewer links
    than it has members.  Of buckets with more than BUCKET_BYTES of payloads all near and possibly similar pairs across components are given, open: to be confirmed.
    """

    def run(batches):
        for t in _whole_buckets(batches):
            t = t.combine_chunks()
            rep, n, lab, sig = (t.column(c).to_numpy() for c in ("rep", "n", "lab", "sig"))
            rows, lab, sig = len(rep), lab.copy(), sig.view(np.uint64)
            bits = np.stack([x.to_numpy() for x in t.column("bits").combine_chunks().flatten()], 1).view(np.uint64)
            payload = t.column("payload").combine_chunks()
            is_open = payload.nbytes > BUCKET_BYTES
            if not is_open:
                parts = [sets_of(payload.slice(lo, AT_ONCE)) for lo in range(0, rows, AT_ONCE)]
                sets = [flat[at[k] : at[k + 1]] for flat, at in parts for k in range(len(at) - 1)]
            found: list[tuple[int, int]] = []

            def similar(i: int, y: np.ndarray) -> np.ndarray:
                ok = []
                for lo in range(0, len(y), AT_ONCE):
                    some = y[lo : lo + AT_ONCE]
                    values = np.concatenate([sets[k] for k in some])
                    at = np.minimum(np.searchsorted(sets[i], values), n[i] - 1)
                    common = np.add.reduceat((sets[i][at] == values).astype(np.int64), np.append(0, np.cumsum(n[some])[:-1]))
                    ok.append(100 * common >= percent * (n[i] + n[some] - common))
                return y[np.concatenate(ok)]

            def join(i: int, y: np.ndarray) -> None:
                labels, first = np.unique(lab[y], return_index=True)
                found.extend((i, k) for k in y[first])
                lab[np.isin(lab, labels)] = lab[i]

            def taken() -> pa.RecordBatch:
                x, y = rep[np.array(found)].T
                found.clear()
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), is_open))], ["src", "dst", "open"])

            for i in range(rows - 1):
                y = np.flatnonzero(lab[i + 1 :] != lab[i]) + i + 1
                differ = sig[i] ^ sig[y]
                y = y[np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= FAR]
                y = y[100 * np.minimum(n[i], n[y]) >= percent * np.maximum(n[i], n[y])]
                apart = np.bitwise_count(bits[i] ^ bits[y]).sum(1, dtype=np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * (n[i] + n[y])
                y, apart = y[ok], apart[ok]
                if not len(y):
                    continue
                if is_open:
                    found.extend((i, k) for k in y)
                else:
                    y = y[np.lexsort((apart, lab[y]))]
                    best = np.append(True, lab[y[1:]] != lab[y[:-1]])  # the nearest of each component before the others
                    for some in (y[best], y[~best]):
                        some = some[lab[some] != lab[i]]
                        if len(some) and len(some := similar(i, some)):
                            join(i, some)
                if len(found) > 50_000:
                    yield taken()
            if found:
                yield taken()

    return run


def _links_in_buckets(scratch: Scratch, mixed: DataFrame, payload: DataFrame, percent: int, sets_of: Callable, confirm: Callable) -> DataFrame:
    """Written (src, dst): links of similar members of buckets of up to MIDDLE that join the same components as all of them do."""
    rows = mixed.where(F.col("k") <= MIDDLE) if mixed.counts["huge"] else mixed
    wanted = payload.select("rep", "payload")
    if mixed.counts["rows"] <= FEW:
        wanted = wanted.join(F.broadcast(rows.select("rep").distinct()), "rep", "left_semi")
    rows = rows.select("key", "rep", "n", "lab", "sig", "bits").hint("merge").join(wanted, "rep").repartition("key").sortWithinPartitions("key")
    rows = rows.select("key", "rep", "n", "lab", "sig", "bits", "payload")
    found = scratch.save(rows.mapInArrow(_bucket_links(percent, sets_of), "src long, dst long, open boolean"), open=F.count_if("open"))
    if not found.counts["open"]:
        return found
    pairs = scratch.save(found.where("open").select("src", "dst").distinct())
    links = scratch.save(found.where("not open").select("src", "dst").union(confirm(pairs, payload, percent)))
    scratch.drop(found, pairs)
    return links


def prefixes(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, lab, sig, at, index) of sets (rep, n, lab, sig, payload): elements by which sets of several labels can meet.

    at is the element's place in the set's order, index whether it belongs to the shorter prefix that a smaller set needs.
    """
    one = scratch.save(sets.select("rep", "n", "lab", "sig", F.explode("payload").alias("key")))
    seen = one.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("key", "k")
    shared = lookup(one, ["key"], seen, "inner")
    own = shared.groupBy("rep", "n", "lab", "sig").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("s"))
    alone = F.col("n") - F.size("s")
    out = own.select("rep", "n", "lab", "sig", alone.alias("alone"), F.posexplode("s").alias("at", "e")).withColumn("at", F.col("at") + F.col("alone"))
    most = lambda a, b: F.expr(f"n - ((n * {a} + {b} - 1) div {b})")  # noqa: E731  n - ceil(n * a / b)
    out = out.withColumn("index", F.col("at") <= most(2 * percent, 100 + percent))
    out = scratch.save(out.where(F.col("at") <= most(percent, 100)).select(F.col("e.key").alias("key"), "rep", "n", "lab", "sig", "at", "index"))
    scratch.drop(one)
    return out


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(src, dst) across labels that share an element of their prefixes and can still have enough elements in common."""
    small = rows.where("index").select("key", F.col("at").alias("atd"), *_others(rows))
    both = rows.hint("merge").join(small, "key").where(near("sig", "sd") & fitting(percent, "bits" in rows.columns)).where("lab <> ld and (nd < n or (nd = n and dst < rep))")
    both = both.where(f"{100 + percent} * least(n - at, nd - atd) >= {percent} * (n + nd)")
    return both.select(F.least("rep", "dst").alias("src"), F.greatest("rep", "dst").alias("dst")).distinct()


def similar_components(scratch: Scratch, met: DataFrame, buckets: DataFrame, payload: DataFrame, percent: int, confirm: Callable = confirm_sets, to_sets: Callable = lambda p: p, links: DataFrame | None = None, sets_of: Callable | None = None) -> DataFrame:
    """(node, component) of all links between members of a bucket.

    met: (src, dst, times): each member with the first centres of its buckets, if of fitting size, and in how many they meet.  buckets: (key, rep, sig), written: the
    members of all buckets with two or more, with their signatures and, if at hand, their sizes n.  payload: (rep, n, payload), n the size of the set, and, if at hand, bits, its bitmap.  confirm(pairs,
    payload, percent) keeps similar pairs; to_sets(payload) gives the sets as arrays of longs in place of other payloads.  Where ``links`` is given (written), it holds the
    similar ones of ``met``, which then is the written table of their first centres (src, dst).  sets_of(column of payloads) is (elements, offsets) of their sets, sorted and
    distinct; with it and bits the pairs of large buckets are confirmed where they are found.
    """

    def confirmed(pairs: DataFrame) -> DataFrame:
        out = scratch.save(confirm(pairs, payload, percent))
        return out

    def linked(links: DataFrame) -> DataFrame:
        out = extend_components(scratch, comp, links) if links.counts["rows"] else comp
        scratch.drop(links)
        return out

    def extended(pairs: DataFrame, keep: bool = False) -> DataFrame:
        pairs = scratch.save(pairs)
        out = linked(confirmed(pairs)) if pairs.counts["rows"] else comp
        if keep:
            return out, pairs
        scratch.drop(pairs)
        return out

    first = met
    if links is None:
        first = scratch.save(first_centres(met))
        links = confirmed(first)
    comp = connected_components(scratch, links)
    scratch.drop(links)

    own, bits = "n" in buckets.columns, "bits" in payload.columns
    about = payload.select("rep", "n", *["bits"] * bits)
    whole = _mixed(scratch, buckets, comp, None if own and not bits else about)
    if not whole.counts["rows"]:
        return comp
    if bits:
        comp, used = extended(_by_bitmaps(whole, percent, centres=True)), [whole]
        again = _mixed(scratch, whole.where(F.col("k") > SMALL).drop("lab", "k"), comp, hot=hot_keys(whole, "key")) if whole.counts["large"] else None
        if again and again.counts["rows"]:
            comp = linked(_links_in_buckets(scratch, again, payload, percent, sets_of, confirm)) if sets_of else extended(_by_bitmaps(again, percent, centres=False))
            huge = again.where(F.col("k") > MIDDLE)
            again = _mixed(scratch, huge, comp, hot=hot_keys(again, "key")) if again.counts["huge"] else None
    else:
        hot = hot_keys(whole, "key")
        star = _with_centres(whole, hot, percent, F.col("rep")).distinct()
        comp, second = extended(ordered(star).hint("merge").join(ordered(first), ["src", "dst"], "left_anti"), keep=True)
        mixed = _mixed(scratch, whole.drop("lab", "k"), comp, hot=hot)
        scratch.drop(whole)
        large = mixed.where(F.col("k") > SMALL)
        listed = scratch.save(mixed_pairs(mixed, hot_keys(mixed, "key"), percent))  # written, else Spark moves the join before the distinct
        pairs = listed.hint("merge").join(ordered(first).union(second.select("src", "dst")), ["src", "dst"], "left_anti")
        if mixed.counts["rows"]:
            comp = extended(pairs)
        scratch.drop(listed)
        again, used = _mixed(scratch, large, comp, hot=hot_keys(mixed, "key")) if mixed.counts["large"] else None, [mixed, second]
    if again and again.counts["rows"]:
        sigs = again.select("rep", "sig").distinct()
        sets = _labelled(to_sets(payload.join(sigs, "rep", "left_semi")), comp).join(sigs, "rep")
        rows = written = prefixes(scratch, sets, percent)
        crowded = _mixed(scratch, rows.drop("n") if bits else rows, comp, about if bits else None, hot_keys(rows, "key"))
        if crowded.counts["large"]:
            comp = extended(_stars(crowded.where(F.col("k") > SMALL), hot_keys(crowded, "key"), percent).distinct())
        if bits:
            rows = rows.hint("merge").join(about.drop("n"), "rep")
        comp = extended(_prefix_pairs(_labelled(rows.drop("lab"), comp), percent))
        scratch.drop(written, crowded)
    scratch.drop(*used)
    return comp
