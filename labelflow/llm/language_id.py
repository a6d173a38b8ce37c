"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table serves all languages: a slot holds a bit mask with one bit per
language, in as many words of 64 bits as they need, so the AND of a gram's slots
returns every language whose filter may contain it.
A language's filter holds the grams that are frequent in it and not much rarer
than in the language where they are most frequent.  A text's grams are counted per language
(a popcount of each bit slice), the count that false positives alone would
give is taken off, and the language with the largest share decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch

#: Lengths of grams in bytes; a gram lies within a word or takes in the space at one of its ends.
GRAMS = (3, 4, 5)
#: Labelled documents per language that the filters are learned from, about.
SAMPLE_DOCS = 3000
#: Grams a language's filter holds at most.
FILTER_GRAMS = 20000
#: A gram belongs to a language if its rate is this part of its highest rate in any.
SHARE = 0.25
#: Bloom filter: slots (a power of two) and hashes.
SLOT_BITS, HASHES = 20, 3
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def gram_codes(column):
    """For runs of texts: (from, to, [(gram codes, their text's number)] for each gram length)."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(column, "")), "", " ")
    data, offsets, _ = tx.binary_parts(padded)
    for i, j in tx.chunks(offsets):
        a = _LETTER[data[offsets[i] : offsets[j]]]
        space = a == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[:1] = True
        at = np.flatnonzero(keep)
        a, space = a[at], space[at]
        doc = np.searchsorted(offsets[i : j + 1] - offsets[i], at, side="right") - 1
        wide = a.astype(np.uint64)
        out = []
        for n in GRAMS:
            if len(a) < n:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            m = len(a) - n + 1
            ok = np.ones(m, bool)
            for k in range(1, n - 1):
                ok &= ~space[k : k + m]
            code = np.full(m, np.uint64(n))
            for k in range(n):
                code = (code << np.uint64(8)) | wide[k : k + m]
            out.append((code[ok], doc[1 : m + 1][ok]))
        yield i, j, out


def slots(codes: np.ndarray, h: int) -> np.ndarray:
    x = codes * _MUL[h]
    return ((x ^ (x >> np.uint64(29))) * _MUL[(h + 1) % 3] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class LanguageFilters:
    """The learned filters: ``languages`` (most labelled first), the slot table and false-positive rates."""

    def __init__(self, grams: dict[str, np.ndarray], order: list[str]):
        self.languages = order
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(order) <= np.iinfo(t).bits), np.uint64)
        self.bits = np.iinfo(kind).bits
        self.table = np.zeros((-(-len(order) // self.bits), 1 << SLOT_BITS), kind)  # words x slots
        self.false = np.zeros(len(order))
        for k, lang in enumerate(order):
            word, bit = self.table[k // self.bits], kind(k % self.bits)
            for h in range(HASHES):
                word[slots(grams[lang], h)] |= kind(1) << bit
            self.false[k] = (word >> bit & kind(1)).mean() ** HASHES

    def counts(self, parts, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(grams of each text, corrected hits of each text and language)."""
        total, hits = np.zeros(texts, np.int64), np.zeros((texts, len(self.languages)))
        for codes, doc in parts:
            at = [slots(codes, h) for h in range(HASHES)]
            total += np.bincount(doc, minlength=texts)
            for w, word in enumerate(self.table):
                mask = word[at[0]]
                for x in at[1:]:
                    mask &= word[x]
                for k in range(w * self.bits, min((w + 1) * self.bits, len(self.languages))):
                    hits[:, k] += np.bincount(doc[(mask >> mask.dtype.type(k % self.bits) & mask.dtype.type(1)).astype(bool)], minlength=texts)
        return total, np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false))


def _gram_counter(batches):
    """(lang, gram, n): how often each gram occurs in a task's texts."""
    for batch in batches:
        lang = batch.column(0).to_pylist()
        names = sorted(set(lang))
        number = np.array([names.index(x) for x in lang])
        sums: dict[str, list] = {x: [] for x in names}
        for i, _, parts in gram_codes(batch.column(1)):
            for codes, doc in parts:
                which = number[i + doc]
                for k, name in enumerate(names):
                    sums[name].append(np.unique(codes[which == k], return_counts=True))
        for name, found in sums.items():
            codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageFilters | None:
    """Filters from rows with a language; a bounded sample of SAMPLE_DOCS rows per language.

    The rows of a language are sampled by a hash of the id, at a rate taken from
    its count.  Every language gets a filter.  None without rows.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).where("lang is not null and text is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return None
    order = [r["lang"] for r in found]
    rates = rows.sparkSession.createDataFrame([(r["lang"], min(1 << 20, SAMPLE_DOCS * (1 << 20) // r["count"] + 1)) for r in found], "lang string, most long")
    rows = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("most"))
    scratch = Scratch(rows.sparkSession)
    grams = scratch.save(rows.select("lang", "text").mapInArrow(_gram_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    totals = rows.sparkSession.createDataFrame(grams.groupBy("lang").agg(F.sum("n").alias("all")).collect(), "lang string, all long")
    top = grams.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= 2 * FILTER_GRAMS)
    top = top.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    own = top.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("best"))
    kept = own.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= FILTER_GRAMS).select("lang", "gram").toArrow()
    scratch.drop(grams)
    names, gram = kept.column("lang").to_numpy(), kept.column("gram").to_numpy()
    by = np.argsort(names, kind="stable")
    names, gram = names[by], gram[by]
    start, stop = np.searchsorted(names, order), np.searchsorted(names, order, side="right")
    sets = {x: gram[i:j] for x, i, j in zip(order, start, stop)}
    return LanguageFilters({x: g.astype(np.int64).view(np.uint64) for x, g in sets.items()}, order)


def _predictor(filters: LanguageFilters | None):
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lang, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if filters is not None:
                for i, j, parts in gram_codes(column):
                    total, hits = filters.counts(parts, j - i)
                    lang[i:j] = hits.argmax(1)
                    score[i:j] = np.minimum(1, hits.max(1) / np.maximum(total, 1))
            some = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang[~some], score[~some] = -1, 0
            names = np.array([*(filters.languages if filters is not None else []), "und"], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[lang], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: LanguageFilters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``.

    lang_pred is a learned language, or ``und`` for a null text, one without
    a letter, or without any learned language.  score in [0, 1] is the corrected share of
    the text's grams that the language's filter holds.  Ties, and texts of unknown
    grams only, go to the language with most labelled rows.  Whole texts are read.
    Repeated rows and null ids pass through; extra columns are ignored; an empty
    table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_predictor(filters), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: LanguageFilters | None, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language with at least ``min_score``.

    Texts that are null, have no letter or mostly consist of unknown grams go.  Without
    any learned language nothing can be judged and all rows stay.
    """
    if filters is None:
        return docs
    at, predict = docs.columns.index(text_col), _predictor(filters)

    def run(batches):
        for batch in batches:
            found = next(predict([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at).cast(pa.string())], ["doc_id", "text"])]))
            yield batch.filter(pc.and_(pc.not_equal(found.column("lang_pred"), "und"), pc.greater_equal(found.column("score"), min_score)))

    return docs.mapInArrow(run, docs.schema)
