"""Byte streams of any size as blocks, and their segmentation into messages that may span any number of blocks.

``read_blocks`` reads files in byte ranges by a Python data source; ``stream_blocks`` deals rows that hold chunks of streams
into blocks.  ``segment_stream`` then works in four steps: a table per block, in parallel; the state in which each block
is entered, by following the tables of a stream in order (a small row per block); the segments of each block; and the
pieces of those that span blocks put together by their offset.  No task holds a stream; a message that is too
long is only measured.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelflow.sources.framing import BLANK, Framing
from labelflow.sources.scan import HALO, START, scanner
from labelflow.tables import running, written

#: Bytes of a block, and of a file that one task reads.
BLOCK, SPLIT = 1 << 20, 64 << 20
SCHEMA = "stream string, block long, at long, size int, parts array<binary>"


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, end: int):
        self.path, self.lo, self.hi, self.end = path, lo, hi, end


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.split = options["path"], int(options.get("block", BLOCK)), int(options.get("split", SPLIT))

    def partitions(self):
        from pyarrow import fs

        store, path = _opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        step = max(1, self.split // self.block) * self.block  # ranges are whole blocks
        return [_Range(f.path, lo, min(lo + step, f.size), f.size) for f in files for lo in range(0, f.size, step)] or [_Range("", 0, 0, 0)]

    def read(self, part):
        if part.hi == part.lo:
            return
        with _opened(self.path)[0].open_input_file(part.path) as f:
            for at in range(part.lo, part.hi, self.block):
                data = f.read_at(min(self.block + HALO, part.end - at), at)
                size = min(self.block, part.end - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([at // self.block], pa.int64()), pa.array([at], pa.int64()), pa.array([size], pa.int32()), pa.array([[data]], pa.list_(pa.binary()))],
                    ["stream", "block", "at", "size", "parts"])


class BlockSource(DataSource):
    """Files, or all files below a folder, as blocks; options: path, block, split."""

    @classmethod
    def name(cls):
        return "byte_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """The files at ``path`` as blocks, a stream each, named by its path.

    Files may have any size: a task reads ``split`` bytes of one, block by block.  Paths are local or URIs that Arrow's file systems
    open (file, hdfs, s3, gs); executors read them directly.  Empty files have no blocks.
    """
    spark.dataSource.register(BlockSource)
    return spark.read.format("byte_blocks").option("block", str(block)).option("split", str(split)).load(path)


def stream_blocks(df: DataFrame, stream: str, order: str, data: str, block: int = BLOCK) -> DataFrame:
    """Rows that hold chunks of streams as blocks of those streams; ``order`` is a unique whole number within a stream.

    Chunks may have any size, empty ones too; null chunks count as empty, a null stream is a stream of its own and is named
    null.  A stream without bytes has no blocks.
    """
    chunk = F.col(data).cast("binary")
    sized = df.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("_k"), chunk.alias("_c")).where("octet_length(_c) > 0")
    sized = sized.withColumn("_n", F.octet_length("_c").cast("long"))
    at = running(sized, "_k", ("stream",), strict=True, _at=("sum", F.col("_n"))).withColumn("_at", F.coalesce("_at", F.lit(0)).cast("long"))
    own = F.explode(F.expr(f"sequence(greatest(0L, (_at - {HALO}) div {block}), (_at + _n - 1) div {block})"))
    cut = at.select("stream", "_at", "_n", "_c", own.alias("block"))
    lo, hi = F.greatest(F.col("_at"), F.col("block") * block), F.least(F.col("_at") + F.col("_n"), (F.col("block") + 1) * block + HALO)
    part = F.when(hi > lo, F.substring(F.col("_c"), (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int")))
    parts = cut.select("stream", "block", lo.alias("lo"), (F.least(hi, (F.col("block") + 1) * block) - lo).alias("n"), part.alias("part")).where("part is not null")
    grouped = parts.groupBy("stream", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("p"), F.sum(F.greatest(F.col("n"), F.lit(0))).cast("int").alias("size"))
    return grouped.where("size > 0").select("stream", "block", (F.col("block") * block).alias("at"), "size", F.col("p.part").alias("parts"))


def _bytes(column, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column[k].as_py()), np.uint8)


def _tables(framing: Framing):
    def run(batches):
        scan = scanner(framing)
        for batch in batches:
            at, size = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tables = [pickle.dumps(scan.table(_bytes(batch.column(4), k), size[k], at[k])) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tables, pa.binary())], ["stream", "block", "at", "size", "table"])

    return run


LAST = "stream string, block long, state array<long>, last boolean"


def _chain(framing: Framing, in_order: bool):
    """Rows (stream, block, at, size, table or parts) in order -> the state in which each block is entered, and, with ``last``, that at
    the end of each stream, under the number of its last block."""

    def run(batches):
        scan = scanner(framing)
        stream, state, seen, block = None, START, False, 0
        for batch in batches:
            out = []
            names, blocks, ats, sizes = (batch.column(c).to_pylist() for c in range(4))
            for k in range(batch.num_rows):
                if not seen or names[k] != stream:
                    if seen:
                        out.append((stream, block, state, True))
                    stream, state, seen = names[k], START, True
                block = blocks[k]
                out.append((stream, block, state, False))
                if in_order:
                    state = scan.segments(state, _bytes(batch.column(4), k), sizes[k], ats[k])[1]
                else:
                    state = scan.step(state, pickle.loads(batch.column(4)[k].as_py()), ats[k], sizes[k])
            yield _state_rows(out)
        if seen:
            yield _state_rows([(stream, block, state, True)])

    return run


def _state_rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([[int(v) for v in x] for x in c] if k == 2 else c, t) for k, (c, t) in enumerate(zip(columns, kinds))], ["stream", "block", "state", "last"])


#: ink: the place of the first byte that is not white space.
PIECES = "stream string, offset long, kind string, from long, n long, data binary, cr boolean, ink long, whole boolean"
_BLANK = np.zeros(256, bool)
_BLANK[[*BLANK]] = True


def _pieces(framing: Framing):
    """Rows (stream, at, size, parts, state) -> pieces: whole segments, and parts of those that are open at an end of the block."""
    scan = scanner(framing)
    limit = framing.limit + framing.width * (framing.kind == "length_prefix")

    def run(batches):
        for batch in batches:
            names, ats, sizes = (batch.column(c).to_pylist() for c in range(3))
            states = batch.column(4).to_pylist()
            for k in range(batch.num_rows):
                a, at, n = _bytes(batch.column(3), k), ats[k], sizes[k]
                found, end = scan.segments(tuple(states[k]), a, n, at)
                since = end[3]
                if since < at + n:  # what stays open
                    found = [*found, ("unframed" if framing.kind in ("markers", "json") and not end[0] else "", since, at + n)]
                if not found:
                    continue
                kind, begin, stop = zip(*found)
                begin, stop = np.array(begin, np.int64), np.array(stop, np.int64)
                lo = np.maximum(begin, at)
                ok = stop >= lo
                open_end = np.zeros(len(begin), bool)
                open_end[-1] = since < at + n
                whole = (begin >= at) & ~open_end
                kept = ok & np.array([x != "unframed" for x in kind]) & (lo - begin <= limit) & (~whole | (stop - begin <= limit + 2))
                raw, ink = a.tobytes(), np.append(np.flatnonzero(~_BLANK[a]), len(a) + 1)
                i, j = lo - at, np.maximum(stop - at, lo - at)
                data = [raw[x:y] if z else None for x, y, z in zip(i.tolist(), j.tolist(), kept)]
                cr = (j > i) & (a[np.maximum(j - 1, 0)] == 13)
                first = ink[np.searchsorted(ink, i)]
                columns = [pa.array([names[k]] * len(begin), pa.string()), pa.array(begin), pa.array(kind, pa.string()), pa.array(lo), pa.array(j - i), pa.array(data, pa.binary()), pa.array(cr), pa.array(first + at, mask=first >= j), pa.array(whole)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in columns], ["stream", "offset", "kind", "from", "n", "data", "cr", "ink", "whole"])

    return run


def segment_stream(blocks: DataFrame, framing: Framing) -> DataFrame:
    """(stream, kind, offset, message, dropped) of blocks of streams: a row per message or framing error, as ``segment`` gives for one text.

    kind is message, oversize, truncated or unframed, offset the place in the stream.  The blocks of a stream have one
    size, but for the last.  Framings whose marks can overlap and length prefixes depend on all that was before: a
    stream's blocks are then read in order by one task, though not held.  An empty table gives an empty result.
    """
    if framing.kind == "none":
        raise ValueError("a stream without framing has no messages; use its chunks")
    if max(len(framing.start), len(framing.end)) > HALO:
        raise ValueError(f"marks of streams have {HALO} bytes at most")
    in_order = getattr(scanner(framing), "in_order", False)
    blocks = written(blocks)
    tables = blocks if in_order else blocks.mapInArrow(_tables(framing), "stream string, block long, at long, size int, table binary")
    states = written(tables.repartition("stream").sortWithinPartitions("stream", "block").mapInArrow(_chain(framing, in_order), LAST))
    inner = states.where("not last").select(F.col("stream").alias("s"), F.col("block").alias("b"), "state")
    both = blocks.hint("merge").join(inner, F.col("stream").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("stream", "at", "size", "parts", "state")
    pieces = both.mapInArrow(_pieces(framing), PIECES)

    # what is open at the end of a stream is a last line, or cut short
    closing = {"lines": "message", "ndjson": "message"}.get(framing.kind, "truncated")
    loose = F.get("state", F.lit(0)) == 0 if framing.kind in ("markers", "json") else F.lit(False)
    end = states.where("last").select("stream", F.get("state", F.lit(3)).alias("offset"), F.when(loose, "unframed").otherwise(closing).alias("kind"), F.lit(None).cast("long").alias("from"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"), F.lit(False).alias("cr"), F.lit(None).cast("long").alias("ink"), F.lit(False).alias("whole"))
    parts = pieces.where("not whole").union(end)
    # kinds of a segment's pieces: '' while it is open, then what ends it
    order = F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("from", "data"))))
    put = parts.groupBy("stream", "offset").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), order.alias("p"), F.coalesce(F.max(F.when(F.col("n") > 0, F.struct("from", "cr")))["cr"], F.lit(False)).alias("cr"), F.min("ink").alias("ink"))
    put = put.where("n > 0 or kind = 'message'").where("n > 0 or " + ("false" if framing.kind in ("lines", "ndjson") else "true"))
    put = put.mapInArrow(_joined, "stream string, offset long, kind string, n long, data binary, cr boolean, ink long")
    all_ = pieces.where("whole").select("stream", "offset", "kind", "n", "data", "cr", "ink").union(put)

    text = framing.kind in ("lines", "ndjson")
    head = framing.width if framing.kind == "length_prefix" else 0
    n = F.col("n") - F.when(F.col("cr"), 1).otherwise(0) if text else F.col("n") - head
    out = all_.withColumn("size", F.when(F.col("kind") == "message", n).otherwise(F.col("n")))
    if framing.kind == "ndjson":
        out = out.where("ink is not null")
    if framing.kind == "json":  # white space between objects is no error
        loose = F.col("kind") == "unframed"
        out = out.where(~loose | F.col("ink").isNotNull()).withColumn("size", F.when(loose, F.col("size") + F.col("offset") - F.col("ink")).otherwise(F.col("size"))).withColumn("offset", F.when(loose, F.col("ink")).otherwise(F.col("offset")))
    kind = F.when((F.col("kind") == "message") & (F.col("size") > framing.limit), "oversize").otherwise(F.col("kind"))
    out = out.withColumn("kind", kind)
    message = F.when(F.col("kind") == "message", F.substring("data", head + 1, F.col("size").cast("int")))
    return out.select("stream", "kind", "offset", message.alias("message"), F.when(F.col("kind") == "message", 0).otherwise(F.col("size")).cast("long").alias("dropped"))


def _joined(batches):
    for batch in batches:
        data = pa.array([b"".join(p["data"] for p in x or () if p) for x in batch.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], data, batch.column(5), batch.column(6)], ["stream", "offset", "kind", "n", "data", "cr", "ink"])
