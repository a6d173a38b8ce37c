"""Sharding, whitening and collocations against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import collocation, queries, sharding, whitening

DOCS = "doc_id long, text string, lang string, size string, shard int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, n, "x", 7) for i, t, n in rows], DOCS)


# sharding


def check_shards(rows, got, n):
    assert sorted((i is None, i or 0, zlib.crc32((t or "").encode())) for i, t, _ in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"]) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, sizes = sum(r["size"] for r in got) / n, Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in got)
    assert all(abs(sizes[s] - share) <= largest + share / sharding.TOLERANCE for s in range(n))
    whole = defaultdict(set)
    for r in got:
        whole[r["text_crc32"]].add(r["shard"])
    total = Counter()
    for r in got:
        total[r["text_crc32"]] += r["size"]
    assert all(len(s) == 1 for t, s in whole.items() if total[t] * sharding.TOLERANCE <= share)  # small groups stay together


def test_shards_are_even_and_keep_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w" * int(rng.integers(0, 300)) + str(i // 2), "en") for i in range(3000)]
    rows += [(10_000 + i, "the same text", "en") for i in range(1500)]  # a third of all rows
    rows += [(20_000, "repeated", "en")] * 900  # rows that cannot be told apart
    rows += [(None, None, None), (None, "", None), (1, None, "x"), (2, "ü" * 2000, "de")]
    got = sharding.shard_records(docs_of(spark, rows), 8).collect()
    check_shards(rows, got, 8)
    assert {r["size"] for r in got if r["doc_id"] == 2} == {4001, len(rows[2][1]) + 1}
    assert {r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"repeated")} != {0}


def test_shards_do_not_depend_on_partitions_or_sample(spark):
    rows = [(i, "abc " * (i * 7919 % 97), "en") for i in range(800)]
    one = sharding.shard_records(docs_of(spark, rows).coalesce(1), 5, seed=1)
    two = sharding.shard_records(docs_of(spark, rows[::-1]).repartition(7), 5, seed=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERFULL", 0.01)  # every range
    rows = [(i, "a" * (i % 50), "en") for i in range(1000)] + [(5000, "same", "en")] * 300
    check_shards(rows, sharding.shard_records(docs_of(spark, rows), 4).collect(), 4)


def test_shards_of_few_rows(spark):
    assert sharding.shard_records(docs_of(spark, []).where("false"), 4).collect() == []
    got = sharding.shard_records(docs_of(spark, [(1, "only", "en")]), 4).collect()
    assert [(r["slot"], r["size"]) for r in got] == [(0, 5)] and 0 <= got[0]["shard"] < 4


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "en") for i in range(100)]
    name = sharding.write_shards(docs_of(spark, rows), str(tmp_path / "out"), 4, file_rows=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and sorted(r["doc_id"] for r in back.collect()) == list(range(100))
    assert {r["shard_"] for r in back.select("shard_").distinct().collect()} == {0, 1, 2, 3} and set(back.columns) == {"doc_id", "text", "lang", "size", "shard", "shard_"}


# whitening


def vectors_of(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], f"vec_id long, embedding {kind}, whitened int")


def brute_whitening(v, k):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    d = (n * x - total) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return d @ u / np.sqrt(e), e / np.trace(d.T @ d / n), ((n * x.astype(object) - total.astype(object)) ** 2).sum(1)


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_whitening_equals_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    v = rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) + 3
    df = vectors_of(spark, [(i, x.tolist()) for i, x in enumerate(v)], "array<double>").repartition(5)
    model = whitening.fit(df, components=6, tile=tile)
    want, explained, deviation = brute_whitening(v, 6)
    got = {r["vec_id"]: r for r in model.transform(df, whitened="z", deviation="q").collect()}
    z = np.array([got[i]["z"] for i in range(700)])
    assert np.allclose(np.abs((z * want).mean(0)), 1) and np.allclose(z * np.sign((z * want).sum(0)), want, atol=1e-8)
    assert [got[i]["q"] for i in range(700)] == list(deviation) and np.allclose(model.explained, explained, rtol=1e-9)
    assert model.identity_error(df) < 1e-9 and {r["whitened"] for r in got.values()} == {3}


def test_whitening_leaves_out_what_has_no_place(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    rows = [*good, *good, (90, None), (91, [1.0, None, 2.0]), (92, [nan, 0.0, 0.0]), (93, [inf, 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = vectors_of(spark, rows, "array<double>")
    model = whitening.fit(df)
    assert model.n == 81 and model.dim == 3 and model.components.shape == (3, 2)  # the third dimension has no variance
    out = model.transform(df, whitened="z").collect()
    assert len(out) == len(rows) and {r["vec_id"] for r in out if r["z"] is None} == {90, 91, 92, 93, 94, 95, 96}
    assert all(len(r["z"]) == 2 for r in out if r["z"] is not None)
    assert whitening.fit(df.where("false")) is None and whitening.whiten(df.where("false"))[0].count() == 0
    same = whitening.fit(vectors_of(spark, [(i, [2.0, 2.0]) for i in range(5)]))
    assert same.components.shape == (2, 0) and same.identity_error(df) == 0.0


def test_deviations_are_exact_or_null():
    y, rest = np.array([[1 << 20, -3], [1 << 33, 0]]), np.array([1, 2])
    assert whitening._squares(y[:1], rest, 1000).to_pylist() == [((1000 << 20) - 1) ** 2 + 3002**2]
    assert whitening._squares(y, rest, 1000).to_pylist() == [((1000 << 20) - 1) ** 2 + 3002**2, None]


def test_whitening_query(spark):
    got = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    v = np.array([r[0] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    want, explained, deviation = brute_whitening(v.astype(float), 32)
    pdf = got.toPandas()
    z = pdf.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(z * np.sign((z * want).sum(0)), want, atol=1e-8) and (pdf["identity_error"] < 1e-9).all()
    assert list(pdf[pdf["component"] == 1].sort_values("vec_id")["deviation"]) == list(deviation)
    assert np.allclose(pdf.groupby("component")["explained"].first(), explained, rtol=1e-9)


# collocations


def brute_collocations(rows, least, top=2000):
    import re

    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, g in f.items():
        c = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in c.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * g[p[i : i + m]]}
        found = []
        for p, a in c.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made_texts(seed, count=150):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "gamma", "d", "été", "x\x01y", "ÀÉ", "zz", "the", "of", " nb", "q w"]
    seps = [" ", " ", " ", "\t", ". ", ", ", "\n", "; ", "!", " : "]
    out = []
    for i in range(count):
        k = rng.zipf(1.5, 60) % len(words)
        out.append((i, "".join(words[j] + seps[rng.integers(len(seps))] for j in k), [None, "en", "und", "de"][i % 4]))
    return out


@pytest.mark.parametrize("least", [2, 30])
def test_collocations_equal_brute_force(spark, least):
    rows = [*made_texts(least), (1, None, "en"), (2, "", "en"), (3, " .,; \t\n", "fr"), (None, "new york city " * 40, "en"), *[(9, "copy of a copy", "en")] * 50]
    got = collocation.collocations(docs_of(spark, rows).repartition(6), least=least)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least)


def test_collocations_in_many_chunks(spark, monkeypatch):
    rows = [(0, " ".join(t for _, t, _ in made_texts(7)), "en"), (1, "one two three " * 400, "en"), *made_texts(8, 40)]
    whole = sorted(map(tuple, collocation.collocations(docs_of(spark, rows), least=5).collect()))
    monkeypatch.setattr(collocation, "CHUNK", 300)  # long texts are cut between pieces
    assert sorted(map(tuple, collocation.collocations(docs_of(spark, rows), least=5).collect())) == whole == brute_collocations(rows, 5)


def test_radix_order_of_wide_ids():
    w = np.random.default_rng(3).integers(0, 1 << 20, 5000).astype(np.uint32) // 40000
    for kind in (np.uint16, np.uint32):
        at, n = collocation._runs(w.astype(kind), np.arange(len(w) - 2), 3)
        want = Counter(zip(w[:-2].tolist(), w[1:-1].tolist(), w[2:].tolist()))
        assert [tuple(w[a : a + 3].tolist()) for a in at] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_collocations_of_nothing(spark):
    none = docs_of(spark, [(1, None, "en"), (2, "a b c", "en")])
    assert collocation.collocations(none).collect() == [] and collocation.collocations(none.where("false")).collect() == []
    got = collocation.collocations(docs_of(spark, [(k, "a b", "en") for k in range(40)] + [(99, "c d " * 50, "en")]), top=1).collect()
    assert [(r["rank"], r["phrase"]) for r in got] == [(1, "a b")]


def test_chunks_of_phrases_are_dealt_out(spark, monkeypatch):
    from labelflow.llm import common

    seen, save = [], common.Scratch.save

    def spy(self, df, **measures):
        out = save(self, df, **measures)
        if out.columns == ["codes", "many", "pos", "id"]:
            seen.extend(r["n"] for r in out.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
        return out

    monkeypatch.setattr(common.Scratch, "save", spy)
    monkeypatch.setattr(collocation, "CHUNK", 100)
    d = spark.createDataFrame([(i, "one two three four, five six seven " * 3, "en") for i in range(60)], "doc_id long, text string, lang string")
    assert collocation.collocations(d, least=30).count() > 0
    assert sum(seen) >= 60 and max(seen) <= 12  # of 60 or more chunks


def test_encoding_a_chunk_takes_bounded_memory():
    """Two workers of an executor encode at once: what a chunk takes beside its texts is small."""
    import tracemalloc

    words = ["".join(chr(97 + c) for c in w) for w in np.random.default_rng(1).integers(0, 26, (5000, 5))]
    text = " ".join(w + "," * (k % 8 == 0) for k, w in enumerate(words))
    data = np.frombuffer((text * (collocation.CHUNK // len(text))).encode(), np.uint8)
    tracemalloc.start()
    collocation.encode(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak
