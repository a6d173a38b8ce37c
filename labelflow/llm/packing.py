"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Documents become token ids plus an end id; only those longer than a sequence are
cut.  Pieces are dealt out by hash to groups of bounded size.  In a group,
longest first, each piece goes where the squared counts of open bins per residual gap
become smallest.  Bins that stay loose after that are opened again and
their pieces packed in a next level across groups, until one group is left.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .text import runs

#: Pieces of a packing group, about.
GROUP = 16384
#: Bins filled less than this are packed again at the next level.
TIGHT = 0.985
#: Words whose ids a worker remembers at most; characters of texts whose new words are encoded together.
REMEMBER, TOGETHER = 600_000, 1 << 20

# In these texts NFC, white space as single spaces and lower case, the normalisation of the
# vocabularies that PARTS describes, change letters' case only, and their split into words is that
# of WORDS; all other texts, and all texts under other vocabularies, are encoded as a whole.
PLAIN = re.compile("[\t\n\x0b\x0c\r -~¡-¬®-ÿ–—‘’“”…]*")
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


# The normaliser and the split that this holds for.
PARTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
)


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes; words are encoded once and remembered.

    The vocabulary splits texts into words before it merges, so a text's ids are its
    words' ids one after another.  New words of many texts are encoded together, parted by
    spaces; a token that ends a word says so in its name.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made, vocab = json.loads(self.tok.to_str()), self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for name, i in vocab.items():
            self.ends[i] = name.endswith("</w>")
        split = (made["pre_tokenizer"] or {}).get("pretokenizers") or [None]
        self.by_words = self.ends.any() and (made["normalizer"], split[0]) == PARTS
        # texts with an added token in them are encoded as a whole, as the vocabulary has it
        names = [re.escape(t["content"]) for t in made["added_tokens"] if t["content"]]
        self.added = re.compile("|".join(names), re.IGNORECASE) if names else None
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) == len(words) and cut[-1] == len(ids):
            flat, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
            parts = [flat[a:b] for a, b in zip(cut, cut[1:])]
        else:
            parts = [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        self.known.update(zip(words, parts))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the words that are new in any of them are encoded in one call."""
        plain = [self.by_words and PLAIN.fullmatch(t) and not (self.added and self.added.search(t)) for t in texts]
        words = [WORDS.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = set().union(*filter(None, words)).difference(self.known)
        if new:
            self.learn(list(new))
        ids = self.known.__getitem__
        return [b"".join(map(ids, w)) if w is not None else self.whole(t) if t else b"" for t, w in zip(texts, words)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cutter(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        enc, tail = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, ids in enumerate(ids for i, j in runs(texts, TOGETHER) for ids in enc.encode(texts[i:j])):
                ids += tail
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    for c, v in zip(rows, (at, k, lo // 4, len(part) // 4, zlib.crc32(part), part)):
                        c.append(v)
                    if not keep_ids:
                        rows[5].pop()
            at, *rest = rows
            out = [pc.take(batch.column(0), pa.array(at, pa.int32())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rest[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at ``capacity``.

    Null and empty texts consist of the end id alone.  Whole texts are encoded, added tokens in them as the vocabulary has
    it.  Rows with a null id are packed like all others and keep it.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return base.mapInArrow(_cutter(tokenizer_path, capacity, end_id, keep_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given; lengths are 1 to capacity.

    N(g) open bins have a gap of g.  Moving a bin from gap g to g - s changes the sum of
    N(g)**2 by 2 * (N(g - s) - N(g)) + 2, closing one by 1 - 2 * N(s), and a new bin
    by 2 * N(capacity - s) + 1.  The least change wins, ties go to the tightest bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = None
        if s < capacity:
            have = count[s:capacity]
            change = 2 * (count[: capacity - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = np.iinfo(np.int64).max
            j = int(change.argmin())
            if have[j] and change[j] <= 2 * count[capacity - s] + 1:
                gap = s + j
        if gap is None:
            b, rest = bins, capacity - s
            bins += 1
        else:
            b, rest = open_bins[gap].pop(), gap - s
            count[gap] -= 1
        if rest:
            count[rest] += 1
            open_bins[rest].append(b)
        out[k] = b
    return out


def _packer(capacity: int, level: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = t.column("length").to_numpy()
        b = sum_of_squares(length, capacity)
        order = np.argsort(b, kind="stable")
        t, length, b = t.take(pa.array(order)), length[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        before = np.cumsum(length) - length
        offset = before - np.repeat(before[first], np.diff(np.append(first, len(b))))
        fill = np.repeat(np.add.reduceat(length, first), np.diff(np.append(first, len(b))))
        group = t.column("grp").to_numpy()
        sequence = (np.int64(level) << 56) + (group.astype(np.int64) << 20) + b
        t = t.drop_columns(["grp"])
        return t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return run


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset: where each piece lies.

    A sequence holds ``capacity`` tokens at most, its pieces without gaps from offset 0.
    Repeated rows are packed as pieces of their own; an empty table gives an empty result.
    """
    scratch = Scratch(cut.sparkSession)
    todo, level, done = scratch.save(cut), 0, []
    columns = todo.columns
    n = todo.count()
    while True:
        groups = max(1, math.ceil(n / GROUP))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema.fields) + ", sequence_id long, offset long, fill long"
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit(level)), F.lit(groups)).cast("long"))
        packed = scratch.save(dealt.groupBy("grp").applyInArrow(_packer(capacity, level), schema))
        if groups == 1:
            done.append(packed.drop("fill"))
            break
        done.append(packed.where(F.col("fill") >= TIGHT * capacity).drop("fill"))
        todo = packed.where(F.col("fill") < TIGHT * capacity).select(*columns)
        left, level = todo.count(), level + 1
        if not left:
            break
        if left > 0.9 * n or level > 30:  # no gain from another level
            done.append(packed.where(F.col("fill") < TIGHT * capacity).drop("fill"))
            break
        n = left
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; ``packed`` must have ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
