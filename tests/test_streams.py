"""Streams in blocks: any block size gives what one text gives; files in byte ranges; scanners against loops over bytes."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelflow.sources import blocks, framing as fr, scan

CASES = [
    (fr.lines(), b"a\n\r "), (fr.ndjson(), b"a\n\r "), (fr.delimiter(b";"), b"a;"), (fr.delimiter(b"ab"), b"abc"), (fr.delimiter(b"aa"), b"ab"), (fr.fixed(3), b"abc"),
    (fr.markers(b"{", b"}"), b"{}x"), (fr.markers(b"<a", b">b"), b"<a>bx"), (fr.markers(b"|", b"|"), b"|x"), (fr.markers(b"ab", b"ca"), b"abc"), (fr.markers(b"aa", b"b"), b"ab"),
    (fr.length_prefix(1), bytes([0, 1, 2, 3, 9])), (fr.length_prefix(2, "little"), bytes([0, 0, 1, 2, 3])), (fr.json_objects(), b'{}"\\ x')]


def in_blocks(data, f, size):
    """(segments, state at the end) of a text cut into blocks; tables and segments must lead to the same states."""
    scanner, state, out = scan.scanner(f), scan.START, []
    for at in range(0, len(data), size):
        n, a = min(size, len(data) - at), np.frombuffer(data[at : at + size + scan.HALO], np.uint8)
        found, new = scanner.segments(state, a, n, at)
        if not getattr(scanner, "in_order", False):
            assert tuple(map(int, scanner.step(state, scanner.table(a, n, at), at, n))) == tuple(map(int, new))
        out, state = out + found, new
    return out, state


def byte_by_byte(data, f):
    """Messages of nesting framings by a loop over bytes."""
    out, depth, quoted, escaped, since, i = [], 0, False, False, 0, 0
    while i < len(data):
        if f.kind == "json":
            c = data[i : i + 1]
            if not depth:
                if c == b"{":
                    if i > since:
                        out.append(("unframed", since, i))
                    depth, since, quoted = 1, i, False
            elif c == b'"' and not escaped:
                quoted = not quoted
            elif c in b"{}" and not quoted:
                depth += 1 if c == b"{" else -1
                if not depth:
                    out.append(("message", since, i + 1))
                    since = i + 1
            escaped = c == b"\\" and not escaped
            i += 1
        elif depth and data.startswith(f.end, i):
            depth, i = depth - 1, i + len(f.end)
            if not depth:
                out.append(("message", since, i))
                since = i
        elif data.startswith(f.start, i):
            if not depth and i > since:
                out.append(("unframed", since, i))
            since, depth, i = i if not depth else since, depth + 1, i + len(f.start)
        else:
            i += 1
    return out, since, depth


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(CASES), st.lists(st.integers(0, 5), max_size=30), st.sampled_from([1, 2, 3, 5, 8, 64]))
def test_blocks_of_any_size(case, letters, size):
    f, alphabet = case
    data = bytes(alphabet[x % len(alphabet)] for x in letters)
    found, state = in_blocks(data, f, size)
    assert (found, state[3]) == (lambda x: (x[0], x[1][3]))(in_blocks(data, f, 1000))
    if f.kind in ("markers", "json"):
        want, since, depth = byte_by_byte(data, f)
        assert (found, state[3], state[0]) == (want, since, depth)


def test_loose_bytes_are_linear():
    data = b'x{"}' * 250_000  # never closes
    took = {}
    for text in (b"x{}" * 350_000, b'"{}' * 350_000, data, b"{" * 1_000_000, b"}" * 1_000_000):
        began = time.time()
        fr.split(text, fr.json_objects())
        took[text[:4]] = time.time() - began
    assert max(took.values()) < 3, took  # a minute and more if it were quadratic


def rows_of(df):
    return sorted((r["stream"], r["offset"], r["kind"], bytes(r["message"]) if r["message"] is not None else None, r["dropped"]) for r in df.collect())


def whole(streams, f):
    return sorted((s, at, kind, m, dropped) for s, data in streams.items() for kind, at, m, dropped in fr.split(data, f))


LIMITED = [fr.Framing("lines", end=b"\n", limit=5), fr.Framing("markers", b"{", b"}", limit=5), fr.Framing("length_prefix", width=1, limit=3), fr.Framing("json", b"{", b"}", limit=9)]


@pytest.mark.parametrize("case", [*CASES, *[(f, b"ab\n\r{}" if f.kind != "length_prefix" else bytes([0, 2, 3, 5, 7])) for f in LIMITED]], ids=str)
def test_chunks_of_streams(spark, case):
    f, alphabet = case
    rng = np.random.default_rng(len(alphabet))
    streams, rows = {}, []
    for s in ("a", "b", "c"):
        data = bytes(alphabet[x] for x in rng.integers(0, len(alphabet), 300))
        cuts = [0, *sorted(rng.integers(0, 300, 40).tolist()), 300]
        rows += [(s, 3 * k - 50, data[lo:hi], "x") for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        streams[s] = data
    rows += [("a", 10_000, None, "x"), ("empty", 1, b"", "x")]
    df = spark.createDataFrame(rows, "s string, k long, c binary, block string").repartition(5)
    got = rows_of(blocks.segment_stream(blocks.stream_blocks(df, "s", "k", "c", block=16), f))
    want = whole(streams, f)
    assert got == want
    assert blocks.segment_stream(blocks.stream_blocks(df.where("false"), "s", "k", "c"), f).collect() == []


@pytest.mark.parametrize("f", [fr.lines(), fr.markers(b"<p>", b"</p>"), fr.json_objects(), fr.length_prefix(4)], ids=lambda f: f.kind)
def test_files_in_ranges(spark, tmp_path, f):
    rng = np.random.default_rng(3)
    texts = ["wörter " * int(n) for n in rng.integers(0, 4000, 120)]
    make = {"lines": lambda t: t.encode() + b"\n", "markers": lambda t: f"<p>{t}<p>x</p></p> ".encode(), "json": lambda t: ('{"a": {"b": "' + t + '}\\\\\\""}}\n').encode(), "length_prefix": lambda t: len(t.encode()).to_bytes(4, "big") + t.encode()}[f.kind]
    data = b"".join(map(make, texts))
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.bin").write_bytes(data)
    (tmp_path / "feed" / "empty.bin").write_bytes(b"")
    (tmp_path / "feed" / "_skipped").write_bytes(b"x")
    small = blocks.read_blocks(spark, str(tmp_path / "feed"), block=1 << 12, split=1 << 14)
    assert small.rdd.getNumPartitions() > 50
    got = rows_of(blocks.segment_stream(small, f))
    assert [x[1:] for x in got] == [x[1:] for x in rows_of(blocks.segment_stream(blocks.read_blocks(spark, str(tmp_path / "feed" / "a.bin")), f))]
    assert [x[1:] for x in got] == [x[1:] for x in whole({"a": data}, f)]
