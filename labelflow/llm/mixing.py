"""Mixing sources to target weights: a native plan of DataFrame operations.

1. Words are counted; a running sum (ranges of ids in parallel, then within ranges) places each
   document in its source's stream of words, which is cut into blocks of equal length: shorter ones for sources of few
   words, so that whole blocks come near any target.
2. Each source's target follows from its weight, stopped at a multiple of its size.
3. Output slots are dealt to shards.  Every slot draws its source, so a shard's
   source counts are multinomial.  A source's draws beyond its quota of blocks go,
   in order, to sources short of theirs, so that totals meet the targets.
4. The k-th slot of a source maps through a pseudorandom permutation of the source's block
   numbers, keyed by the seed, the source and the time round, and slots join blocks by that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a block at most, blocks of a source at least (where it has so many words), slots of an output shard, documents of a range.
BLOCK, FINE, SHARD_SLOTS, RANGE_DOCS = 128, 100, 4096, 20000
#: Cells by which numbers find the part that they lie in.
CELLS = 1024
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of a permutation, and how often it is applied again to a number outside of the blocks; with 40 or fewer cells
#: outside that is always enough, with more a chance below (1 / 40) ** 40.
ROUNDS, WALKS = 4, 40
# A prime, a multiplier and an increment of the pseudorandom function.
PRIME, BY, PLUS = 2147483647, 1103515245, 12345


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with sid, weight and target.

    Sources in code-point order, null last, take the weights in turn.  Together they get
    ``share`` times all words; none gets more than ``repeat`` times its own size, and
    what that leaves goes to the others by weight, until none is above.  This is the level L
    with sum(min(cap, L * weight)) = total, read off the sources ordered by cap / weight.
    One row per source; the windows run over that table only.
    """
    s = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * repeat).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "sid")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", share * F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "source_size", "sid", "weight", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _row_key(docs: DataFrame, *names: str) -> list:
    """Two hashes that tell rows apart by id, text and source; rows equal in all three are alike anyway."""
    cols = [F.col(f"`{n}`") for n in names]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(1), *cols[::-1]).alias("k2")]


class Mix:
    """The parts of a mixture; all are DataFrames.

    documents: one row per input row: doc_id, source, size, sid, width, start (words before it in its source).
    sources: source, source_size, sid, weight, target, width (words of a block), n_blocks, quota.
    draws: shard, sid, c: the multinomial counts of each shard.
    slots: shard, slot, sid, turn, block.
    """

    def __init__(self, scratch: Scratch, documents: DataFrame, sources: DataFrame, draws: DataFrame, slots: DataFrame):
        self.scratch, self.documents, self.sources, self.draws, self.slots = scratch, documents, sources, draws, slots

    def segments(self) -> DataFrame:
        """(sid, start, block, lo, words): the part of each document in each block; lo counts from its start."""
        d = self.documents.where("size > 0")
        d = d.withColumn("block", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")))
        lo = F.greatest(F.col("block") * F.col("width"), F.col("start")) - F.col("start")
        hi = F.least((F.col("block") + 1) * F.col("width"), F.col("start") + F.col("size")) - F.col("start")
        return d.select("sid", "start", "doc_id", "block", lo.alias("lo"), (hi - lo).alias("words"))

    def times(self) -> DataFrame:
        """(sid, block, times): how often each block is taken."""
        return self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))

    def mixed(self) -> DataFrame:
        """(shard, slot, sid, block, doc_id, lo, words): the mixture itself, slot by slot."""
        return self.slots.join(self.segments(), ["sid", "block"]).select("shard", "slot", "sid", "block", "doc_id", "lo", "words")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, drawn (slots that drew the source, before surplus draws are passed on), taken of every input row."""
        by_doc = self.segments().join(self.times(), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        same = (F.col("d.sid") == F.col("t.sid")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0)
        out = self.documents.alias("d").join(by_doc.alias("t"), same, "left")
        out = out.select("d.doc_id", "d.sid", "d.size", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))
        drawn = self.draws.groupBy("sid").agg(F.sum("c").alias("drawn"))
        named = self.sources.select("sid", "source_size", "target").join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        return out.join(named, "sid").select("doc_id", "size", "source_size", "target", "drawn", "taken")


def pseudorandom(*parts):
    """A number from 0 to PRIME - 1 that depends on all of the numbers ``parts``: a fold of squares and products modulo PRIME."""

    def fold(x, p):
        y = (x + p) % PRIME
        return (y * y % PRIME * F.lit(BY).cast("long") + p + PLUS) % PRIME

    numbers = [F.pmod(p.cast("long"), F.lit(PRIME)) for p in parts]
    return F.aggregate(F.array(*numbers, F.lit(1).cast("long"), F.lit(2).cast("long")), F.lit(1).cast("long"), fold)


def sides(n):
    """(a, b) with a * b >= n, as near to a square as whole numbers allow."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.ceil(n / a).cast("long")


def _turned(x, a, b, *key):
    """A Feistel network over the a * b cells: each round adds a keyed function of one coordinate to the other."""
    l, r = x % a, F.floor(x / a).cast("long")
    for k in range(ROUNDS):
        if k % 2 == 0:
            l = (l + pseudorandom(*key, F.lit(k), r)) % a
        else:
            r = (r + pseudorandom(*key, F.lit(k), l)) % b
    return r * a + l


def permuted(k, n, *key):
    """The image of k under a permutation of 0 .. n-1 that the numbers ``key`` choose: a keyed Feistel network, walked on while outside."""
    a, b = sides(n)
    once = lambda x: _turned(x, a, b, *key)
    first = once(k)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))
    return F.when(first >= n, walked).otherwise(first)


def in_cells(rows: DataFrame, at: str, parts: DataFrame, lo: str, hi: str, total: int) -> DataFrame:
    """``rows`` with the columns of the one of ``parts`` whose lo <= at < hi; the parts divide 0 .. total - 1.

    Both sides are cut into CELLS equal cells and joined on them, so a row meets the few parts of its cell only.
    """
    total = max(1, total)
    cut = parts.where(f"{hi} > {lo}").withColumn("cell", F.explode(F.expr(f"sequence(cast(floor(cast({lo} as decimal(38)) * {CELLS} / {total}) as long), cast(floor(cast({hi} - 1 as decimal(38)) * {CELLS} / {total}) as long))")))
    return rows.withColumn("cell", F.expr(f"cast(floor(cast({at} as decimal(38)) * {CELLS} / {total}) as long)")).join(cut, "cell").where(f"{at} >= {lo} and {at} < {hi}").drop("cell")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeat: float = 2.0, block: int = BLOCK, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix ``docs`` by source.

    Null texts and texts without words have size 0 and are never taken.  A null source
    is a source of its own.  Rows that repeat are rows of their own.  Null ids come first in their source.  Extra columns are
    ignored.  An empty table gives empty parts.  All draws are functions of slot numbers, so
    reruns agree.  A source may have some 2**61 blocks; no document is taken more than
    ceil(repeat) times.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *_row_key(docs, id_col, text_col, source_col))
    sized = scratch.save(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat)
    sources = sources.withColumn("width", F.expr(f"greatest(1L, least({block}L, source_size div {FINE}))"))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0)
    sources = scratch.save(sources.withColumn("quota", quota.cast("long")))

    n, all_slots = sized.count(), sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    ranges = max(1, -(-n // RANGE_DOCS))
    placed = sized.join(sources.select(F.col("source").alias("s"), "sid", "width"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "sid", "width", "k1", "k2")
    placed = scratch.save(placed.repartitionByRange(ranges, "sid", "doc_id").withColumn("range", F.spark_partition_id()))
    part = placed.groupBy("sid", "range").agg(F.sum("size").alias("words"))
    part = part.withColumn("base", F.sum("words").over(Window.partitionBy("sid").orderBy("range")) - F.col("words")).drop("words")
    inner = F.sum("size").over(Window.partitionBy("sid", "range").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    documents = placed.withColumn("inner", inner).join(part, ["sid", "range"]).select("doc_id", "source", "size", "sid", "width", "k1", "k2", (F.col("inner") + F.col("base")).alias("start"))
    documents = scratch.save(documents)
    scratch.drop(sized, placed)

    # every slot draws a source by its share of the quotas
    by_sid = Window.orderBy("sid")  # a row per source
    edges = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(by_sid)).withColumn("lo", F.col("hi") - F.col("quota"))
    total = max(1, all_slots)
    u = (pseudorandom(F.lit(seed), F.col("id")) * F.lit(1 << 31) + pseudorandom(F.lit(seed + 1), F.col("id"))) % total
    slots = spark.range(all_slots).select(F.col("id").alias("slot"), (F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), u.alias("u"))
    drawn = in_cells(slots, "u", edges.select("sid", "quota", "lo", "hi"), "lo", "hi", total).select("shard", "slot", "sid", "quota")
    counts = drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("c"))  # multinomial, shard by shard
    counts = scratch.save(counts.withColumn("base", F.sum("c").over(Window.partitionBy("sid").orderBy("shard")) - F.col("c")))
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    drawn = drawn.withColumn("k", rank).join(counts.drop("c"), ["shard", "sid"]).withColumn("k", F.col("k") + F.col("base")).drop("base")

    # draws beyond a quota pass to the sources that are short, in order
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    state = sources.where("quota > 0").select("sid", "quota").join(got, "sid", "left").fillna(0, ["got"])
    state = state.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("lack", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    state = scratch.save(state.withColumn("over_base", F.sum("over").over(by_sid) - F.col("over")).withColumn("lack_base", F.sum("lack").over(by_sid) - F.col("lack")))
    spares = state.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    own = drawn.where("k < quota").select("shard", "slot", "sid", "k")
    spare = drawn.where("k >= quota").join(state.select("sid", "over_base"), "sid").select("shard", "slot", (F.col("k") - F.col("quota") + F.col("over_base")).alias("i"))
    short = state.where("lack > 0").select("sid", "got", "lack_base", (F.col("lack_base") + F.col("lack")).alias("lack_end"))
    passed = in_cells(spare, "i", short, "lack_base", "lack_end", spares).select("shard", "slot", "sid", (F.col("i") - F.col("lack_base") + F.col("got")).alias("k"))
    turn = F.expr("k div n_blocks")
    slots = own.union(passed).join(sources.select("sid", "n_blocks"), "sid").select("shard", "slot", "sid", turn.alias("turn"), F.expr("k % n_blocks").alias("k"), "n_blocks")
    slots = slots.select("shard", "slot", "sid", "turn", permuted(F.col("k"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("turn")).alias("block"))
    return Mix(scratch, documents, sources, counts.select("shard", "sid", "c"), slots)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mixture takes them: one row per copy, the text cut to the blocks that copy has.

    Returns the columns of ``docs``.  The c-th copy of a document consists of the words in
    those of its blocks that are taken c times or more, with the white space after
    them; a copy that has all blocks is the text unchanged.  Documents that are
    not taken (all those without words among them) go.
    """
    m = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    seg = m.segments().join(m.times(), ["sid", "block"], "left").select("sid", "start", F.struct("lo", "words", F.coalesce("times", F.lit(0)).alias("times")).alias("s"))
    seg = seg.groupBy("sid", "start").agg(F.array_sort(F.collect_list("s")).alias("parts"))
    d, t = m.documents.alias("d"), seg.alias("t")
    d = d.join(t, (F.col("d.sid") == F.col("t.sid")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0))
    d = d.select("d.k1", "d.k2", "t.parts", F.row_number().over(Window.partitionBy("d.k1", "d.k2").orderBy("d.start")).alias("occ"))
    d = d.withColumn("copies", F.array_max(F.transform("parts", lambda p: p["times"]))).where("copies > 0")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key(docs, id_col, text_col, source_col))
    keyed = keyed.withColumn("occ", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1))))
    both = keyed.join(d, ["k1", "k2", "occ"]).withColumn("c", F.explode(F.expr("sequence(1L, copies)")))
    text = F.col("row").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    has = lambda p: p["times"] >= F.col("c")
    cut = F.array_join(F.flatten(F.transform(F.filter("parts", has), lambda p: F.slice(words, (p["lo"] + 1).cast("int"), p["words"].cast("int")))), "")
    new = F.when(F.forall("parts", has), text).otherwise(cut)
    return both.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
