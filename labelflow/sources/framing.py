"""Byte streams to messages: framings as a DataFrame operator.

``segment(df, data, framing)`` turns a binary column into one row per message with its
offset, and one row per framing error; it works file by file or row by row in parallel.  For
text files with plain lines ``read_lines`` stays in Spark's own reader.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.sources.scan import START, scanner

BLANK = b" \t\n\r\x0b\x0c"
#: A message longer than this is an error.
MAX_MESSAGE = (16 << 20) - (64 << 10)


@dataclass(frozen=True)
class Framing:
    """kind: none, lines, ndjson, delimiter, markers, length_prefix or fixed, with what it needs."""

    kind: str
    start: bytes = b""
    end: bytes = b""
    width: int = 0
    order: str = "big"
    limit: int = MAX_MESSAGE


def lines() -> Framing:
    return Framing("lines", end=b"\n")


def ndjson() -> Framing:
    return Framing("ndjson", end=b"\n")


def delimiter(d: bytes) -> Framing:
    return Framing("delimiter", end=d)


def markers(start: bytes, end: bytes) -> Framing:
    return Framing("markers", start, end)


def length_prefix(width: int, order: str = "big") -> Framing:
    if width not in (1, 2, 4, 8):
        raise ValueError("a length prefix has 1, 2, 4 or 8 bytes")
    return Framing("length_prefix", width=width, order=order)


def fixed(n: int) -> Framing:
    return Framing("fixed", width=n)


def json_objects(limit: int = MAX_MESSAGE) -> Framing:
    """Objects written one after another; braces within strings do not count."""
    return Framing("json", b"{", b"}", limit=limit)


def _cuts(data: np.ndarray, at: np.ndarray, f: Framing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, message end, whether it is cut short) of each piece of texts that lie one after another.

    For lines, one-byte delimiters and fixed widths, all pieces of all texts at once.
    """
    size = np.diff(at)
    if f.kind == "fixed":
        many = -(-size // f.width)
        text = np.repeat(np.arange(len(size)), many)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = at[text] + k * f.width
        end = np.minimum(begin + f.width, at[text + 1])
        return text, begin, end, end - begin < f.width
    marks = np.flatnonzero(data == f.end[0])
    marks = marks[(marks >= at[0]) & (marks < at[-1])]
    inner = at[1:][(size > 0)]
    open_end = inner[(inner == 0) | (data[np.maximum(inner - 1, 0)] != f.end[0])]  # texts that do not end with a mark
    end = np.sort(np.concatenate([marks, open_end * 1.0 - 0.5]).astype(np.float64)) if len(open_end) else marks.astype(np.float64)
    cut_short = end != np.floor(end)
    end = np.ceil(end).astype(np.int64)
    text = np.searchsorted(at, end - cut_short, side="right") - 1
    begin = np.concatenate([[0], end[:-1] + ~cut_short[:-1]]).astype(np.int64)
    return text, np.maximum(begin, at[text]), end, cut_short


def _vector_rows(data: np.ndarray, at: np.ndarray, f: Framing):
    """(text, kind, offset, messages, dropped) of all texts, for the framings of ``_cuts``."""
    text, begin, end, short = _cuts(data, at, f)
    stop, tail = end.copy(), f.kind in ("delimiter", "fixed")
    if f.kind == "delimiter":
        stop = end + ~short
    elif f.kind != "fixed":
        has_cr = (stop > begin) & (data[np.maximum(stop - 1, 0)] == 13)
        stop = stop - has_cr
    if f.kind == "ndjson":
        ink = np.concatenate([[0], np.cumsum(~np.isin(data, np.frombuffer(BLANK, np.uint8)))])
        some = ink[stop] > ink[begin]
        text, begin, stop, short = (x[some] for x in (text, begin, stop, short))
    size = stop - begin
    kind = np.where(short & tail, "truncated", np.where(size > f.limit, "oversize", "message"))
    shown = np.where(kind == "message", size, 0)
    flat = data[np.repeat(begin - np.cumsum(shown) + shown, shown) + np.arange(shown.sum())]
    ends = np.concatenate([[0], np.cumsum(shown)]).astype(np.int32)
    valid = np.packbits(kind == "message", bitorder="little")
    messages = pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(valid.tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
    return text, kind, begin - at[text], messages, size - shown


def split(data: bytes, f: Framing) -> list[tuple[str, int, bytes | None, int]]:
    """(kind, offset, message, bytes dropped) of one text: kind message, or the error truncated, oversize or unframed."""
    if not data:
        return []
    if f.kind in ("lines", "ndjson", "fixed") or (f.kind == "delimiter" and len(f.end) == 1):
        _, kind, offset, messages, dropped = _vector_rows(np.frombuffer(data, np.uint8), np.array([0, len(data)]), f)
        return list(zip(kind.tolist(), offset.tolist(), messages.to_pylist(), dropped.tolist()))
    out: list[tuple[str, int, bytes | None, int]] = []

    def put(at: int, message: bytes):
        out.append(("oversize", at, None, len(message)) if len(message) > f.limit else ("message", at, message, 0))

    n = len(data)
    if f.kind == "none":
        put(0, data)
    else:
        found, state = scanner(f).segments(START, np.frombuffer(data, np.uint8), n, 0)
        since = state[3]
        if since < n:  # what is open at the end
            found = [*found, ("unframed" if f.kind in ("markers", "json") and not state[0] else "truncated", since, n)]
        head = f.width if f.kind == "length_prefix" else 0
        for kind, lo, hi in found:
            if kind == "message":
                put(lo, data[lo + head : hi])
            elif f.kind != "json" or kind == "truncated":
                out.append((kind, lo, None, hi - lo))
            elif loose := data[lo:hi].lstrip(BLANK):  # white space between objects is no error
                out.append((kind, hi - len(loose), None, len(loose)))
    return out


def segment(df: DataFrame, data: str, framing: Framing) -> DataFrame:
    """The other columns of ``df`` with kind, offset, message (binary) and dropped, a row per message or error.

    A null value has no messages.
    """
    keep = [f for f in df.schema.fields if f.name != data]
    src = df.select(*[f"`{f.name}`" for f in keep], F.col(data).cast("binary").alias("_data"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "kind string, offset long, message binary, dropped long"
    names = [f.name for f in keep]
    at_once = framing.kind in ("lines", "ndjson", "fixed") or (framing.kind == "delimiter" and len(framing.end) == 1)

    def run(batches):
        for batch in batches:
            column = batch.column(len(names)).fill_null(b"")
            if at_once:
                at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                flat = column.buffers()[2]
                flat = np.frombuffer(flat, np.uint8) if flat is not None and at[-1] else np.zeros(1, np.uint8)
                text, *found = _vector_rows(flat, at, framing)
            else:
                rows = [(k, *m) for k, x in enumerate(column) for m in split(x.as_py(), framing)]
                text, *found = (list(c) for c in zip(*rows)) if rows else ([], [], [], [], [])
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
            out = [batch.column(k).take(pa.array(text, pa.int64())) for k in range(len(names))]
            out += [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(out, [*names, "kind", "offset", "message", "dropped"])

    return src.mapInArrow(run, schema)


def read_json_objects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, reports) of files of JSON objects one after another; bad objects and loose text are reported."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))
    rows = segment(files, "data", json_objects()).withColumn("value", F.decode("message", "UTF-8"))
    parsed = rows.withColumn("r", F.from_json("value", f"struct<{schema}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    fine = (F.col("kind") == "message") & F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    bad = parsed.where(~fine).select(F.when(F.col("kind") == "message", "schema_mismatch").otherwise(F.col("kind")).alias("kind"), F.col("path").alias("node"), F.coalesce("value", F.col("dropped").cast("string")).alias("detail"))
    return parsed.where(fine).select("r.*").drop("_corrupt"), bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, split at \\n alone, one final \\r removed."""
    return spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, reports) of newline-delimited JSON; blank lines are skipped and bad ones reported."""
    rows = read_lines(spark, path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", f"struct<{schema}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")
    bad = parsed.where("r is null or r._corrupt is not null").select(F.lit("schema_mismatch").alias("kind"), F.lit(None).cast("string").alias("node"), F.col("value").alias("detail"))
    return good, bad
