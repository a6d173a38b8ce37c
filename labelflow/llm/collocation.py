"""Phrase collocation mining: frequent phrases of 2 to 4 words whose parts occur mostly together, by language.

1. Texts are cut into pieces and words once.  A chunk of pieces keeps its words as numbers of its own, with a list of its
   distinct words; both are written.
2. Words are counted from those lists.  The frequent ones get dense ids (32 bits, one for each language and word) in order; each
   chunk's list is joined with them, so no table of words is broadcast.  All other words break pieces.
3. Phrases are packed into fixed-width binary keys, four ids of 32 bits.  A chunk's phrases are put in order by a radix sort over
   16-bit digits and counted as runs; keys are range-partitioned, sorted and counted as runs again.
4. Pairs come first.  A Bloom filter of the frequent ones, of fixed size, sifts the longer phrases before they are
   shuffled: a phrase can be frequent only if all its pairs are.  A false hit costs a row, never a result.
5. Scores, the test against longer phrases and the spelling are joins on keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, lookup
from .text import binary_parts, chunks, mix

#: Longest phrase, bytes of text in a chunk, bits of the filter (as a power of two) and of a part of it, parts of a language's ranking.
WORDS, CHUNK, FILTER_BITS, PART_BITS, PARTS = 4, 4 << 20, 26, 20, 64
#: Chunks of a part that is counted by one task, about.
DEALT = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1  # between words
_KIND[[*b".,;:!?", *range(10, 14)]] = 2  # between pieces


def _cut_long(data: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
    """Offsets with further ones inside of texts longer than ``limit``: after the first end of a piece behind each ``limit`` bytes."""
    more = []
    for k in np.flatnonzero(np.diff(at) > limit):
        stops = np.flatnonzero(_KIND[data[at[k] : at[k + 1]]] == 2) + 1 + at[k]
        want = np.searchsorted(stops, np.arange(at[k] + limit, at[k + 1], limit))
        more.append(stops[np.unique(want[want < len(stops)])])
    return np.unique(np.concatenate([at, *more])) if more else at


def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(numbers of the words from 1, with 0 where a piece ends; the distinct words; how often each occurs) of texts one after another."""
    a = _LOWER[data[at[0] : at[-1]]]
    at = at - at[0]
    if not len(a):
        return np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(0, np.int64)
    kind = _KIND[a]
    inside = kind == 0
    begins = at[:-1][at[:-1] < len(a)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]  # a word may begin right where a text does
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = begins[begins > 0] - 1
    last[before] = inside[before]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(e - s)])
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(a[inside].tobytes())]).dictionary_encode()
    number = words.indices.to_numpy()
    del last
    stops = np.flatnonzero(kind == 2)  # far fewer than bytes
    piece, text = np.searchsorted(stops, s), np.searchsorted(at, s, side="right")
    new = np.concatenate([[False], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])])[: len(s)]
    codes = np.zeros(len(s) + new.sum(), np.int32)
    codes[np.arange(len(s)) + np.cumsum(new)] = number + 1
    return codes, words.dictionary, np.bincount(number, minlength=len(words.dictionary))


def _encoder(limit: int):
    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                data, at, _ = binary_parts(batch.column(1).filter(pc.equal(lang.indices, code)))
                at = _cut_long(data, at, limit)
                for i, j in chunks(at, limit):
                    codes, words, counts = encode(data, at[i : j + 1])
                    if len(words):
                        wide = codes.astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
                        lists = [pa.array([x.to_pylist() if isinstance(x, pa.Array) else x.tolist()], t) for x, t in ((words.cast(pa.large_string()), pa.list_(pa.string())), (counts, pa.list_(pa.int64())))]
                        yield pa.RecordBatch.from_arrays([pa.array([part + k], pa.int64()), pa.array([name], pa.string()), pa.array([int(counts.sum())], pa.int64()), *lists, pa.array([wide.tobytes()], pa.binary())], ["chunk", "lang", "n", "words", "counts", "codes"])
                        k += 1

    return run


def radix_order(digits: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """``at`` in the order of digits[0][at], digits[1][at], ...: a radix sort from the last digit; numpy's stable sort of 16 bits is one."""
    for d in digits[::-1]:
        at = at[np.argsort(d[at], kind="stable")]
    return at


def _runs(w: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where a phrase of ``n`` words first occurs, how often) for the phrases of ``w`` that begin at ``at``, in order."""
    columns = [w[k : len(w) - n + 1 + k] for k in range(n)]
    if w.dtype == np.uint16:
        digits = columns
    else:
        digits = [d for c in columns for d in ((c >> 16).astype(np.uint16), (c & 0xFFFF).astype(np.uint16))]
    at = radix_order(digits, at)
    new = np.zeros(len(at), bool)
    new[:1] = True
    for c in columns:
        x = c[at]
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    return at[starts], np.diff(np.append(starts, len(at)))


def _bits(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The places of pairs of ids in the filter."""
    h = mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    return [(h >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1) for s in (0, 32)]


def _pack(ids: np.ndarray) -> pa.Array:
    """Rows of four ids as 16-byte keys, so that the order of keys is the order of ids."""
    flat = ids.astype(">u4").tobytes()
    ends = np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])


def _unpack(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(keys.buffers()[2], np.uint8)[16 * keys.offset :][: 16 * len(keys)].view(">u4").reshape(-1, 4) if len(keys) else np.zeros((0, 4), ">u4")


GRAMS = "key binary, n long"


def _counter(sieve):
    """Rows (codes, many, pos, id) -> (key, n) of a chunk's pairs, or with ``sieve``, a broadcast filter, of its longer phrases."""

    def run(batches):
        for batch in batches:
            for codes, many, pos, ids in zip(*batch.columns):
                known = np.zeros(many.as_py() + 1, np.uint32)
                known[pos.values.to_numpy() + 1] = ids.values.to_numpy()
                gid = np.unique(known)
                gid = gid if gid[0] == 0 else np.concatenate([np.zeros(1, np.uint32), gid])
                small = np.uint16 if len(gid) < 1 << 16 else np.uint32
                local = np.searchsorted(gid, known).astype(small)  # in the order of ids
                w = local[np.frombuffer(codes.as_py(), np.uint16 if many.as_py() < 1 << 16 else np.uint32)]
                if len(w) < 2:
                    continue
                good = (w[1:] > 0) & (w[:-1] > 0)
                if sieve is not None:
                    bits, at = np.frombuffer(sieve.value, np.uint8), np.flatnonzero(good)
                    for place in _bits(gid[w[at]], gid[w[at + 1]]):
                        hit = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                        good[at[hit == 0]] = False
                for n in (2,) if sieve is None else range(3, WORDS + 1):
                    if len(w) < n:
                        continue
                    ok = good[: len(w) - n + 1].copy()
                    for k in range(1, n - 1):
                        ok &= good[k : len(w) - n + 1 + k]
                    first, count = _runs(w, np.flatnonzero(ok), n)
                    out = np.zeros((len(first), WORDS), np.uint32)
                    for k in range(n):
                        out[:, k] = gid[w[first + k]]
                    for lo in range(0, len(out), 1 << 18):
                        yield pa.RecordBatch.from_arrays([_pack(out[lo : lo + (1 << 18)]), pa.array(count[lo : lo + (1 << 18)], pa.int64())], ["key", "n"])

    return run


def _totals(least: int):
    """Sorted (key, n) -> the keys whose runs sum to ``least`` or more, with the number of their words."""

    def out(keys: np.ndarray, n: np.ndarray):
        keep = n >= least
        ids = keys[keep].astype(">u8").view(">u4").reshape(-1, 4)
        return pa.RecordBatch.from_arrays([_pack(ids), pa.array(n[keep], pa.int64()), pa.array((ids > 0).sum(1), pa.int32())], ["key", "a", "m"])

    def run(batches):
        held, total = None, 0  # the run that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.ascontiguousarray(_unpack(batch.column(0))).view(">u8").reshape(-1, 2).astype(np.uint64)
            n = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            keys, n = keys[starts], np.add.reduceat(n, starts)
            if held is not None:
                if (keys[0] == held).all():
                    n[0] += total
                else:
                    keys, n = np.concatenate([held[None], keys]), np.concatenate([[total], n])
            held, total = keys[-1], n[-1]
            yield out(keys[:-1], n[:-1])
        if held is not None:
            yield out(held[None], np.array([total]))

    return run


def _counted(scratch: Scratch, coded: DataFrame, sieve, least: int) -> DataFrame:
    """(key, a, m) of the phrases that occur ``least`` times or more."""
    grams = scratch.save(coded.mapInArrow(_counter(sieve), GRAMS))
    ordered = grams.repartitionByRange("key").sortWithinPartitions("key")
    out = scratch.save(ordered.mapInArrow(_totals(least), "key binary, a long, m int"))
    scratch.drop(grams)
    return out


def _filter(pairs: DataFrame) -> bytes:
    """A Bloom filter of the keys of ``pairs``: parts are put together in tasks, 2 ** FILTER_BITS bits come to the driver at any size."""

    def places(batches):
        for batch in batches:
            ids = _unpack(batch.column(0))
            for b in _bits(ids[:, 0], ids[:, 1]):
                yield pa.RecordBatch.from_arrays([pa.array((b >> np.uint64(PART_BITS)).astype(np.int64)), pa.array((b & np.uint64((1 << PART_BITS) - 1)).astype(np.int64))], ["part", "bit"])

    def filled(key, table):
        bits = np.zeros(1 << PART_BITS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # places are distinct, so a part has 2 ** PART_BITS rows at most
    found = pairs.select("key").mapInArrow(places, "part long, bit long").distinct().groupBy("part").applyInArrow(filled, "part long, bits binary")
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in found.toLocalIterator():
        lo = r["part"] << (PART_BITS - 3)
        out[lo : lo + (1 << (PART_BITS - 3))] = r["bits"]
    return bytes(out)


def _dictionary(scratch: Scratch, coded: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): the words that occur ``least`` times or more in their language, ids from 1 in their order."""
    each = coded.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    kept = scratch.save(each.where(F.col("f") >= least).repartitionByRange("lang", "word").withColumn("part", F.spark_partition_id()))
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row per partition
    row = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    out = scratch.save(kept.withColumn("k", row).join(F.broadcast(base), "part").select("lang", "word", "f", (F.col("k") + F.col("base")).alias("id")))
    if out.counts["rows"] >= 1 << 32:
        raise ValueError("more than 2 ** 32 frequent words: raise the least count")
    scratch.drop(kept)
    return out


def _part_key(lo: str, many: str):
    """The key of ``many`` words of a key from word ``lo``, from 1."""
    return F.expr(f"rpad(substring(key, 4 * ({lo}) - 3, 4 * ({many})), 16, X'00')")


def collocations(docs: DataFrame, least: int = 30, scale: int = 2_000_000, covered: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Words part at spaces and tabs, pieces at . , ; : ! ? and line ends; A-Z count as a-z.  a is how often the phrase occurs within pieces, l and r its two
    parts at the cut with the least score floor(scale * a / (l + r)) (of ties, the shortest first part), n all words
    of the language.  A phrase goes if a longer frequent one that holds it occurs ``covered`` percent as often or more.  Ties in
    score go by a, then by the bytes of the phrase.  Sums and products are exact.

    A null language is ``und``; null, empty and blank texts have no words.  Repeated rows count as often as they
    occur.  Texts of any length are taken whole.  An empty table, or none of the words frequent, gives an empty result.  Other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    coded = scratch.save(base.mapInArrow(_encoder(CHUNK), "chunk long, lang string, n long, words array<string>, counts array<long>, codes binary"))
    words = _dictionary(scratch, coded, least)
    ids = coded.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).hint("merge").join(words.select("lang", "word", "id"), ["lang", "word"])
    # both are dealt out by a number of parts, which Spark does not merge: a Python worker is sent all chunks of a part at once
    parts = max(1, coded.counts["rows"] // DEALT)
    ids = ids.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list("pos").alias("pos"), F.collect_list("id").alias("id"))  # a chunk's words
    dealt = coded.select("chunk", "codes", F.size("words").alias("many")).repartition(parts, "chunk")
    mapped = scratch.save(dealt.hint("merge").join(ids, "chunk").select("codes", "many", "pos", "id"))
    sizes = scratch.save(coded.groupBy("lang").agg(F.sum("n").alias("n")))
    scratch.drop(coded)

    pairs = _counted(scratch, mapped, None, least)
    sieve = spark.sparkContext.broadcast(_filter(pairs))
    longer = _counted(scratch, mapped, sieve, least)
    sieve.unpersist()
    scratch.drop(mapped)
    phrases = scratch.save(pairs.union(longer))
    scratch.drop(pairs, longer)

    single = words.select(F.expr("rpad(unhex(lpad(hex(id), 8, '0')), 16, X'00')").alias("key"), F.col("f").alias("a"))
    counts = phrases.select("key", "a").union(single)
    cuts = scratch.save(phrases.select("key", "a", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k")).select("key", "a", "k", _part_key("1", "k").alias("left"), _part_key("k + 1", "m - k").alias("right")))
    both = lookup(cuts, ["left"], counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "inner")
    both = lookup(both, ["right"], counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "inner", hot_keys(cuts, "right"))
    big = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"cast({scale} as decimal(10,0)) * {big('a')} div ({big('l')} + {big('r')})")
    scored = both.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))

    inner = phrases.where("m > 2").select("key", "a", "m", F.explode(F.expr("sequence(2, m - 1)")).alias("w")).select("key", "a", "w", F.explode(F.expr("sequence(1, m - w + 1)")).alias("lo"))
    most = inner.select(_part_key("lo", "w").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longest"))
    kept = scored.hint("merge").join(most, "key", "left").where(f"longest is null or 100 * {big('longest')} < {covered} * {big('a')}")
    kept = scratch.save(kept.select("key", "a", "s.l", "s.r", "s.score"))
    scratch.drop(cuts)

    parts = scratch.save(kept.select("key", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("at")).withColumn("id", F.conv(F.hex(F.expr("substring(key, 4 * at + 1, 4)")), 16, 10).cast("long")).where("id > 0"))
    spelt = lookup(parts, ["id"], words.select("id", "lang", "word"), "inner").groupBy("key").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = kept.hint("merge").join(spelt.select("key", "lang", F.array_join("w.word", " ").alias("phrase")), "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
