import json

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelflow.functions import expressions as ex
from labelflow.operators import routing as rt
from labelflow.sources import framing as fr
from labelflow.sources import generators as gen

# Published test vectors of the hash with seed 0.
VECTORS = {"": 0xEF46DB3751D8E999, "a": 0xD24EC4F1A98C6E5B, "abc": 0x44BC2CF5AD770999, "Nobody inspects the spammish repetition": 0xFBCEA83C8A378BF1}


def test_hash_vectors(spark):
    d = spark.createDataFrame([(k,) for k in VECTORS], "k string").withColumn("h", rt.xxh64(F.encode("k", "UTF-8")))
    assert {r["k"]: r["h"] % (1 << 64) for r in d.collect()} == VECTORS


def test_canonical_keys(spark):
    row = spark.range(1).select(
        rt.canonical(("s", F.lit("a")), ("s", F.lit("b"))).alias("ab"), rt.canonical(("s", F.lit("ab"))).alias("a_b"), rt.canonical(("i", F.lit(1))).alias("num"), rt.canonical(("s", F.lit("1"))).alias("txt")).first()
    assert bytes(row["ab"]) == b"s\x01\0\0\0as\x01\0\0\0b" and row["ab"] != row["a_b"] and row["num"] != row["txt"]
    assert xxhash.xxh64_intdigest(bytes(row["num"])) == xxhash.xxh64_intdigest(b"i\x01\0\0\x001")


@pytest.mark.parametrize("n,g", [(4, 128), (3, 128), (7, 64)])
def test_owned_ranges(spark, n, g):
    ranges = sorted((r["instance"], r["group_from"], r["group_to"]) for r in rt.owned_ranges(spark, n, g).collect())
    assert ranges[0][1] == 0 and ranges[-1][2] == g and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))
    for r in spark.range(g).select("id", rt.instance_of(F.col("id"), n, g).alias("i")).collect():
        assert ranges[r["i"]][1] <= r["id"] < ranges[r["i"]][2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=37, max_size=37), min_size=1, max_size=4), st.integers(0, 37))
def test_hash_equals_the_library(rows, n):
    data = np.array([list(r[:n]) for r in rows], np.uint8).reshape(len(rows), n)
    assert [int(h) for h in rt.hash_rows(data)] == [xxhash.xxh64_intdigest(r[:n]) for r in rows]


def test_hash_of_nulls(spark):
    d = spark.createDataFrame([(None,), (b"abc",), (b"",)], "k binary").withColumn("h", rt.xxh64("k"))
    assert [r["h"] if r["h"] is None else r["h"] % (1 << 64) for r in d.collect()] == [None, VECTORS["abc"], VECTORS[""]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=8))
def test_length_prefix_round_trip(parts):
    for width, order in ((1, "big"), (2, "little"), (4, "big"), (8, "little")):
        data = b"".join(len(p).to_bytes(width, order) + p for p in parts)
        assert [m for k, _, m, _ in fr.split(data, fr.length_prefix(width, order)) if k == "message"] == parts


def test_framings():
    got = lambda data, f: [(k, m if k == "message" else d) for k, _, m, d in fr.split(data, f)]
    assert got(b"a\r\n\nb", fr.lines()) == [("message", b"a"), ("message", b""), ("message", b"b")]
    assert got(b"{}\n \n{}\n", fr.ndjson()) == [("message", b"{}")] * 2
    assert got(b"a;b;c", fr.delimiter(b";")) == [("message", b"a;"), ("message", b"b;"), ("truncated", 1)]
    assert got(b"abcde", fr.fixed(2)) == [("message", b"ab"), ("message", b"cd"), ("truncated", 1)]
    assert got(b"x{a{b}c}y{", fr.markers(b"{", b"}")) == [("unframed", 1), ("message", b"{a{b}c}"), ("unframed", 1), ("truncated", 1)]
    assert got(b"abc", fr.Framing("lines", end=b"\n", limit=2)) == [("oversize", 3)]
    assert got(b"", fr.Framing("none")) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.dictionaries(st.text(max_size=4), st.one_of(st.integers(), st.text(alphabet='a{}"\\\\', max_size=6), st.dictionaries(st.text(max_size=2), st.none(), max_size=2)), max_size=3), st.sampled_from(["", " ", "\n"])), max_size=6))
def test_json_objects_round_trip(parts):
    texts = [json.dumps(o) for o, _ in parts]
    data = "".join(t + gap for t, (_, gap) in zip(texts, parts)).encode()
    assert [m.decode() for k, _, m, _ in fr.split(data, fr.json_objects())] == texts


def test_json_objects_with_loose_text(spark, tmp_path):
    # quotes outside of objects do not count, so the brace behind the loose one opens an object, which stays open
    got = fr.split(b'x{"a":"}"} "}{" {"b":{}}{"c', fr.json_objects())
    assert got == [("unframed", 0, None, 1), ("message", 1, b'{"a":"}"}', 0), ("unframed", 11, None, 2), ("truncated", 13, None, 14)]
    assert fr.split(b' "{} \n{"a":"\\""} ', fr.json_objects()) == [("unframed", 1, None, 1), ("message", 2, b"{}", 0), ("message", 6, b'{"a":"\\""}', 0)]
    (tmp_path / "feed.json").write_bytes(b'{"a": 1}{"a": 2} junk {"a": "x"}\n{"a": 3')
    good, bad = fr.read_json_objects(spark, str(tmp_path / "feed.json"), "a bigint")
    assert [r["a"] for r in good.collect()] == [1, 2] and sorted(r["kind"] for r in bad.collect()) == ["schema_mismatch", "truncated", "unframed"]


def naive_split(data, f):
    out, i = [], 0
    while i < len(data):
        j = data.find(f.end, i)
        if j < 0 and f.kind == "delimiter":
            return [*out, ("truncated", i, None, len(data) - i)]
        stop = len(data) if j < 0 else j
        piece = data[i : j + 1] if f.kind == "delimiter" else data[i:stop].removesuffix(b"\r")
        if f.kind != "ndjson" or piece.strip():
            out.append(("message", i, piece, 0))
        i = stop + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=8).map(lambda b: bytes(b"a\n\r ;"[x % 5] for x in b)), max_size=6))
def test_framings_of_many_texts_at_once(texts):
    data, at = np.frombuffer(b"".join(texts) + b"z", np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for f in (fr.lines(), fr.ndjson(), fr.delimiter(b";")):
        text, kind, offset, messages, dropped = fr._vector_rows(data, at, f)
        assert list(zip(text.tolist(), kind.tolist(), offset.tolist(), messages.to_pylist(), dropped.tolist())) == [(k, *m) for k, t in enumerate(texts) for m in naive_split(t, f)]


def test_prefixed_documents_of_any_length(spark, tmp_path):
    from labelflow.queries import QUERIES

    sizes = {1: 0, 2: 65535, 3: 65536, 4: 200_000, 5: fr.MAX_MESSAGE + 1}
    docs = spark.createDataFrame([*sizes.items(), (6, None)], "doc_id long, size int")
    docs.select("doc_id", F.expr("repeat('a', size)").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n"], r["bytes"]) for r in QUERIES["segment_prefixed"](spark, str(tmp_path)).collect()}
    assert got == {i: (2, n + 3) for i, n in sizes.items()}


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("e1,t1,s1",), ("short,row",)], "value string")
    assert [r["entity_id"] for r in gen.parse_transactions(d).collect()] == ["e1"]
    p = gen.parse_plugs(spark.createDataFrame([("1,12x,3.5W,1,p,h,b",), ("1,2",)], "value string")).collect()
    assert len(p) == 1 and p[0]["ts"] == 12 and p[0]["value"] == 3.5
    assert gen.camera(spark, 30).count() == 30 and gen.wearable(spark, 4).select("vitals.heart_rate").count() == 4
    gen.write_json(d, str(tmp_path / "out"))
    assert gen.read_profiles(spark, str(tmp_path / "out"), "value string").count() == 2
    (tmp_path / "x.ndjson").write_bytes(b'{"a": 1}\r\n\nbad\n')
    good, bad = fr.read_ndjson(spark, str(tmp_path / "x.ndjson"), "a bigint")
    assert [r["a"] for r in good.collect()] == [1] and [r["detail"] for r in bad.collect()] == ["bad"]


def test_expressions(spark):
    row = spark.range(1).select(ex.nanos_text(F.lit(1_500_000)).alias("us"), ex.nanos_text(F.lit(7_200_000_000_000)).alias("h"), ex.json_number(F.lit(float("nan"))).alias("nan"), ex.glob(F.lit("edge-7"), "edge-?").alias("g")).first()
    assert tuple(row) == ("1500us", "2h", None, True) and ex.duration("2m") == 120 * 10**9 and ex.size("64MB") == 64 << 20
