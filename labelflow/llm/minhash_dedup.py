"""MinHash near-duplicate detection with tensored banding.

A banded index of tables with keys of four minhashes would need four fresh
minhashes a table.  Here two small collections A and B of half keys, each of
two minhashes, are computed, and every pair (one of A, one of B) is a table:
``side`` * ``side`` tables from 4 * ``side`` minhashes.  Two documents of
similarity s meet unless they miss all half keys of A or all of B, which for
side = 10 and s = 0.8 has a chance of 2 * (1 - s**2)**10 = 7e-5.

The steps:

1. One pass hashes whole texts: set size, set digest and half keys per document.
2. Documents with equal sets become one class at once (a partial aggregation).
3. Half keys of A that only one class has are dropped before tables are formed.
4. Each bucket links its members to its smallest member (a star, not all pairs).
5. Pairs whose minhashes hardly agree are left out.
6. Links are confirmed on full shingle sets and completed across the buckets (see ``similar``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, hot_keys, lookup, with_smallest
from .similar import BITMAP, bitmaps, deal, first_centres, near, similar_components, similar_sets


def _sketcher(width: int, side: int, seed: int):
    def run(batches):
        hasher = tx.MinHasher(4 * side, seed)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            data, offsets, _ = tx.binary_parts(batch.column(2))
            for i, j in tx.chunks(offsets):
                words, first = tx.word_hashes(data, offsets[i : j + 1])
                flat, at = tx.distinct_sets(*tx.shingle_hashes(words, first, width))
                size = np.diff(at)
                d1, d2 = tx.set_digest(flat, at)
                mins = hasher(flat, at)
                full = size > 0
                sig, halves = np.zeros(j - i, np.int64), []
                sig[full] = tx.signature(mins)
                for c in range(2):
                    keys = np.zeros((j - i, side), np.uint64)
                    for k in range(side):
                        col = 2 * (c * side + k)
                        keys[full, k] = tx.fold(mins[:, col : col + 2], (c << 20) + k)
                    halves.append(pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), side).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), texts.slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sig), *halves],
                    ["doc_id", "tk", "n_shingles", "d1", "d2", "sig", "a", "b"],
                )

    return run


def _set_builder(width: int):
    """Rows (rep, dst, centre, text) -> (rep, dst, centre, n, bits, payload), payload the text's set and bits its bitmap."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = tx.binary_parts(batch.column(3))
            for i, j in tx.chunks(offsets):
                words, first = tx.word_hashes(data, offsets[i : j + 1])
                flat, at = tx.distinct_sets(*tx.shingle_hashes(words, first, width))
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
                kept = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at).astype(np.int64)), bitmaps(flat, at), sets], ["rep", "dst", "centre", "n", "bits", "payload"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, side: int = 10, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose word-shingle sets are similar.

    Returns one row per input row: doc_id, n_shingles (distinct shingles of the whole
    text), component_id (smallest doc_id reachable over links of Jaccard similarity
    percent / 100 or more), kept (doc_id = component_id).

    Words are runs of characters other than space and \\x09-\\x0D, with A-Z lower-cased.
    Null and empty texts have an empty set and link with nothing; a text
    with fewer than ``width`` words has its whole sequence as its only shingle.
    Rows with a null id are left out (a class needs a name).  Repeated rows give
    repeated results; rows that share an id with other texts are judged each by its own text.  Extra columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("tk"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    schema = "doc_id long, tk long, n_shingles long, d1 long, d2 long, sig long, a array<long>, b array<long>"
    sketch = scratch.save(base.mapInArrow(_sketcher(width, side, seed), schema))
    reps = sketch.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "tk", "sig", "a", "b")).alias("m"))
    # a class is known by a number of its own: an id may have several texts
    reps = scratch.save(reps.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", F.col("n_shingles").alias("n"), "m.doc_id", "m.tk", "m.sig", "m.a", "m.b"))

    one_half = scratch.save(reps.select("rep", F.explode("a").alias("ha")))
    shared = one_half.groupBy("ha").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ha")
    halves = lookup(one_half, ["ha"], shared, "inner")
    keys = halves.join(reps.select("rep", "n", "sig", "b"), "rep").select("rep", "n", "sig", "ha", F.explode("b").alias("hb"))
    keys = scratch.save(keys.select("rep", "sig", F.col("n").cast("int").alias("n"), F.xxhash64("ha", "hb").alias("key")))

    hot = hot_keys(keys, "key")
    centre = keys.groupBy("key").agg(F.min(F.struct("rep", "n", "sig")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.col("c.rep").alias("dst"), F.col("c.n").alias("nd"), F.col("c.sig").alias("sd"))
    star = scratch.save(lookup(keys, ["key"], centre, "inner", hot))
    scratch.drop(one_half, keys)
    met = star.where((F.col("rep") != F.col("dst")) & near("sig", "sd")).where(f"100 * least(n, nd) >= {percent} * greatest(n, nd)")
    first = scratch.save(first_centres(met.groupBy(F.col("rep").alias("src"), "dst").agg(F.count(F.lit(1)).alias("times"))))

    # each text is dealt out once, by its id and hash; its set is written together with the centre that it is compared with first
    wanted = reps.join(star.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "tk")
    wanted = wanted.hint("merge").join(first.select(F.col("src").alias("rep"), "dst"), "rep", "left")
    wanted = wanted.hint("merge").join(first.select(F.col("dst").alias("rep"), F.lit(True).alias("centre")).distinct(), "rep", "left")
    wanted = scratch.save(wanted)
    texts = base.hint("merge").join(wanted, ["doc_id", "tk"]).select("rep", "dst", "centre", "text")
    sets = scratch.save(texts.mapInArrow(_set_builder(width), f"rep long, dst long, centre boolean, n long, bits {BITMAP}, payload array<long>"))
    if sets.counts["rows"] > wanted.counts["rows"]:  # repeated rows
        once = scratch.save(sets.dropDuplicates(["rep"]))
        scratch.drop(sets)
        sets = once
    both = sets.where("dst is not null").select(F.col("rep").alias("src"), "dst", F.col("payload").alias("sx"))
    links = scratch.save(similar_sets(deal(both, sets.where("centre"), first), percent))
    comp = similar_components(scratch, first, star, sets, percent, links=links)

    named = with_smallest(scratch, reps.select("rep", "d1", "d2", F.col("n").alias("n_shingles"), "doc_id"), comp, "doc_id").select("d1", "d2", "n_shingles", "component_id")
    out = lookup(sketch.select("doc_id", "n_shingles", "d1", "d2"), ["d1", "d2", "n_shingles"], named, hot=hot_keys(sketch, "d1"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.col("doc_id") == F.col("component_id")))
    scratch.drop(sketch, reps, star, first, wanted, sets, comp)
    return out
