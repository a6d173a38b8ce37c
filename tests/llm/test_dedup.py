"""Near-duplicate operators against brute force, and their edge cases."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelflow.llm.embedding_dedup import near_duplicate_vectors
from labelflow.llm.common import Scratch
from labelflow.llm.line_dedup import SHINGLE, _buckets, drop_similar_lines, normal
from labelflow.llm.minhash_dedup import near_duplicates
from labelflow.llm.similar import BITMAP, SMALL, bitmaps, fitting, mixed_pairs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else {tuple(words)} if words else set()


def components(ids, linked):
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def near_texts(n_groups=12, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(30, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" \t".join(copy) if rng.random() < 0.3 else " ".join(copy).upper())
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = near_texts() + [None, "", "  \n", "one", "One", "one two", "a b c", "a b c"]
    texts += [" ".join(f"w{(i * 7 + k) % 9000}" for k in range(6000)) for i in (0, 0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(docs, width=width).collect()}
    sets = [shingle_set(t, width) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(range(len(texts)), links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_large_group_is_finished_in_blocks(spark):
    """Many texts around the threshold in one group: more than blocks of pairs allow to list."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(60)] = f"x{i}_{rng.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, 5) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == components(range(len(texts)), links)


def test_pairs_of_many_shared_buckets_come_once(spark):
    """Two reps that meet in ten buckets are one pair, in small buckets as in large ones."""
    rows = [(key, rep, 0, 10, rep, k) for key, reps, k in [(b, range(3), 3) for b in range(10)] + [(20 + b, range(5, 45), 40) for b in range(10)] for rep in reps]
    mixed = spark.createDataFrame(rows, "key long, rep long, sig long, n int, lab long, k long")
    got = [(r["src"], r["dst"]) for r in mixed_pairs(mixed, [], 80).collect()]
    assert len(got) == len(set(got)) and {(0, 1), (0, 2), (1, 2)} <= set(got)
    assert {i for p in got for i in p} == {*range(3), *range(5, 45)} and len(got) <= 3 + 3 * 39


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, rep long, n int, key string, node int"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f", 1, 1, "k", 1), (1, "a b c d e f", 1, 1, "k", 1), (None, "a b c d e f", 1, 1, "k", 1), (2, None, None, None, None, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1), (1, 1), (2, 2)]


def similar_lines(a, b):
    x, y = ({n[i : i + SHINGLE] for i in range(len(n) - SHINGLE + 1)} or {n} for n in (a, b))
    return 100 * len(x & y) >= 80 * len(x | y)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    pool = [" ".join(word() for _ in range(rng.randint(2, 30))) for _ in range(40)]
    for line in list(pool[:25]):
        w = line.split()
        w[rng.randrange(len(w))] = word()
        pool.append(" ".join(w))
    docs = [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool).upper(), "", "x"]) for _ in range(rng.randint(0, 8)))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0] + " \r\n" + pool[0])]
    got = {r["doc_id"]: r for r in drop_similar_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if normal(line):
                first.setdefault(normal(line), (i, k))
    names = list(first)
    low = components(range(len(names)), [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if similar_lines(names[a], names[b])])
    best = {}
    for k, n in enumerate(names):
        best[low[k]] = min(best.get(low[k], (10**9, 0)), first[n])
    for i, t in docs:
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        keep = [x for k, x in enumerate(t.split("\n")) if not normal(x) or best[low[names.index(normal(x))]] == (i, k)]
        assert got[i]["text"] == "\n".join(keep) and got[i]["n_dropped"] == len(t.split("\n")) - len(keep)


def test_buckets_keep_near_members_and_one_row_per_line():
    """Members of small buckets that are near no other go; large buckets, salted ones and near members stay with the smallest of them."""
    far = 0x5555555555555555
    rows = [(1, 10, 0, -1), (1, 11, far, -1), (2, 20, 0, -1), (2, 21, 1, -1), (2, 19, far, -1), (3, 30, 0, -1), (4, 40, 0, 2), (4, 41, far, 2), (4, 42, 0, 1)]
    rows += [(5, 100 + i, far * (i % 4), -1) for i in range(3 * SMALL)]
    batches = [pa.RecordBatch.from_arrays([pa.array([int(np.int64(np.uint64(v & (2**64 - 1)).view(np.int64))) for v in c], pa.int64()) for c in zip(*part)], ["key", "rep", "sig", "salt"]) for part in (rows[::2], rows[1::2])]
    got = sorted(r for b in _buckets(batches) for r in zip(*(b.column(c).to_pylist() for c in ("key", "salt", "rep", "dst"))))
    assert got[:5] == [(2, -1, 20, 20), (2, -1, 21, 20), (4, 1, 42, 42), (4, 2, 40, 40), (4, 2, 41, 40)]
    assert got[5:] == [(5, -1, 100 + i, 100) for i in range(3 * SMALL)]
    assert list(_buckets([])) == []


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a step are gone when its table is written: they took more disk than the tables."""
    scratch = Scratch(spark)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: disk.getAllFiles().mkString(" ").count("shuffle_")
    before = shuffles()
    saved = scratch.save(spark.range(20_000).repartition(7, "id").withColumn("x", F.col("id") % 5))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and saved.groupBy("x").count().count() == 5


def test_lines_edges(spark):
    schema = "doc_id long, text string, h int, line int, rep int"
    assert drop_similar_lines(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "same line here", 1, 1, 1), (1, "same line here", 1, 1, 1), (1, "same line here", 1, 1, 1), (2, "Same  line here", 5, 5, 5)]
    got = sorted((r["doc_id"] or 0, r["text"], r["h"]) for r in drop_similar_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "same line here", 1), (1, "same line here", 1), (1, "same line here", 1), (2, "", 5)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    v = [x / np.linalg.norm(x) for x in np.concatenate([base, base[:20] + 0.04 * rng.standard_normal((20, 32)), base[:8] + 0.03 * rng.standard_normal((8, 32)), base[:3], 3 * base[3:5]])]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [None] + [1.0] * 31), (905, [float("inf")] * 32), (906, [1.0, 2.0]), (907, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95)) if a < b]
    want = components(range(len(x)), links)
    for i in range(len(x)):
        assert got[i]["n_links"] == sum(i in e for e in links) and got[i]["component_id"] == want[i]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
    assert got[907]["component_id"] == 906 and got[906]["n_links"] == 1
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, rep int, w int")).collect() == []


def test_large_vector_bucket_is_cut_into_blocks(spark, monkeypatch):
    from labelflow.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(24)
    x = np.float32(base + 0.12 * np.linalg.norm(base) / np.sqrt(24) * rng.standard_normal((90, 24)))
    got = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), miss=1e-6).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == {i: int((y[i] @ y.T >= 0.95).sum()) - 1 for i in range(90)}


def test_rows_of_one_id_with_other_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    rows = [(1, "something else entirely that is its own text"), (1, near), (2, base), (3, "short")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 4, 1), (1, 56, 1), (2, 56, 1), (3, 1, 3)]
    lines = [(1, "alpha line of text here\nbeta line that only it has"), (1, "gamma is another line\nalpha line of text here"), (2, "beta line that only it has")]
    left = sorted(t for r in drop_similar_lines(spark.createDataFrame(lines, "doc_id long, text string")).collect() for t in r["text"].split("\n") if t)
    assert left == ["alpha line of text here", "beta line that only it has", "gamma is another line"]
    vectors = [(7, [1.0, 0.0, 0.1]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 0.0, 0.11]), (9, [0.0, 0.0, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect())
    assert got == [(7, 0, 7), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_huge_doubles_keep_their_digits(spark):
    rows = [(1, [1e39, 0.0]), (2, [1e39, 0.0]), (3, [1e39, 1e39]), (4, [16777217.0, 1.0]), (5, [-16777217.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (0, 5)}


def test_planted_vector_pairs_are_found(spark):
    """Recall on pairs right above the threshold among many rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 32))
    side -= (side * x[:2000]).sum(1, keepdims=True) * x[:2000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.999, 2000)[:, None]
    rows = np.concatenate([x, c * x[:2000] + np.sqrt(1 - c * c) * side])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(d).collect()}
    assert np.mean([got[8000 + i] == i for i in range(2000)]) > 0.999 and all(got[i] == i for i in range(2000, 8000))


def test_prefixes_find_what_no_centre_joins(spark, monkeypatch):
    """One bucket of sets that share much and are similar in pairs only: by prefixes the result equals brute force."""
    from labelflow.llm import similar
    from labelflow.llm.common import Scratch

    monkeypatch.setattr(similar, "SMALL", 16)
    rng = random.Random(2)
    common = list(range(40))
    sets = []
    for i in range(60):
        own = [1000 * i + k for k in range(rng.choice([3, 12]))]
        sets.append(common + own)
        if i % 3 == 0:
            sets.append((common + own)[1:] + [500000 + i])
    d = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "rep long, n long, payload array<long>")
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    scratch = Scratch(spark)
    buckets = scratch.save(d.selectExpr("1L as key", "rep", "0L as sig"))
    met = scratch.save(d.where("rep > 0").selectExpr("rep as src", "0L as dst", "1L as times"))
    got = {r["node"]: r["component"] for r in similar.similar_components(scratch, met, buckets, d, 80).collect()}
    want = components(range(len(sets)), links)
    assert {i: got.get(i, i) for i in range(len(sets))} == want and len(set(want.values())) > 10


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    from labelflow.llm import common

    monkeypatch.setattr(common, "HOT_TABLE", 10)
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    scratch = common.Scratch(spark)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in common.connected_components(scratch, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100 + i: 100 for i in range(21)}
    rows = scratch.save(spark.createDataFrame([(1, i) for i in range(30)] + [(2, 0), (None, 1)], "k long, v long"))
    table = spark.createDataFrame([(1, "one"), (3, "three")], "k long, w string")
    assert sorted(((str(r["k"]), r["v"], r["w"]) for r in common.lookup(rows, ["k"], table).collect()), key=str) == sorted([("1", i, "one") for i in range(30)] + [("2", 0, None), ("None", 1, None)], key=str)
    assert common.lookup(rows, ["k"], table, "inner").count() == 30 and common.hot_keys(rows, "k") == [(1, 30)]


def test_lines_that_are_not_quite_similar_are_not_compared_in_pairs(spark, monkeypatch):
    """A large group of lines around the threshold: few pairs but the similar ones get to the exact comparison."""
    from labelflow.llm import line_dedup

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    base, lines = [word() for _ in range(18)], []
    for _ in range(220):
        w = list(base)
        w[rng.randrange(18)] = word()
        w[rng.randrange(18)] = word()
        lines.append(" ".join(w))
    lines += [" ".join(x.split()[:-1]) for x in lines[:40]]
    seen, confirm = [], line_dedup.confirm_lines

    def spy(pairs, lines, percent):
        seen.append(pairs.counts["rows"])
        return confirm(pairs, lines, percent)

    monkeypatch.setattr(line_dedup, "confirm_lines", spy)
    got = {r["doc_id"]: r["text"] for r in drop_similar_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if similar_lines(lines[a], lines[b])]
    low = components(range(len(lines)), links)
    assert got == {i: x if low[i] == i else "" for i, x in enumerate(lines)} and len(set(low.values())) > 60
    assert sum(seen) < 8 * len(lines), seen


@pytest.mark.parametrize("size", [0, 1, 9, 200, 3000])
def test_bitmaps_leave_out_no_similar_set(spark, size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 1 << 52, size, dtype=np.uint64)
    more = rng.integers(0, 1 << 52, size // 4, dtype=np.uint64)
    other = np.concatenate([x[size // 4 // 2 :], more[: size // 4 - size // 4 // 2]])
    far = rng.integers(0, 1 << 52, size, dtype=np.uint64)
    flat, at = np.concatenate([x, other, far]), np.cumsum([0, size, len(other), size])
    rows = pa.table({"bits": bitmaps(flat, at), "n": np.diff(at)}).to_pylist()
    pairs = [(rows[0]["n"], rows[0]["bits"], r["n"], r["bits"], len(set(x.tolist()) & set(s.tolist()))) for r, s in zip(rows, (x, other, far))]
    got = spark.createDataFrame(pairs, f"n long, bits {BITMAP}, nd long, bd {BITMAP}, both long").withColumn("fit", fitting(80, True)).collect()
    assert all(r["fit"] for r in got if 100 * r["both"] >= 80 * (r["n"] + r["nd"] - r["both"]))
    assert size != 200 or not got[2]["fit"]


def test_lines_that_differ_in_white_space(spark):
    words = "some words that make one line of text in a document"
    texts = [words] + [words.replace(" ", c) for c in "\u2003\u0085\u3000\u00a0\t\u1680\u2028"] + ["\u2003\u2003", "\u2003\u2003", "\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in drop_similar_lines(df).collect()}
    assert got == {i: words if i == 0 else "" if i < 8 else t for i, t in enumerate(texts)}


def test_components_of_few_edges_take_two_steps(spark, monkeypatch):
    """A chain is contracted in a task; where tasks hold few edges, rounds across them give the same."""
    from labelflow.llm import common

    rng = random.Random(4)
    ids = rng.sample(range(10_000), 120)
    edges = [(a, b) for part in (ids[:60], ids[60:]) for a, b in zip(part, part[1:])] + [(ids[0], ids[0]), (None, 3)]
    want = {i: min(part) for part in (ids[:60], ids[60:]) for i in part}
    table = spark.createDataFrame(edges, "src long, dst long").repartition(6)
    scratch = common.Scratch(spark)
    comp = common.connected_components(scratch, table)
    assert {r["node"]: r["component"] for r in comp.collect()} == want and comp.counts["rows"] == 120 and scratch.n == 2
    links = scratch.save(spark.createDataFrame([(ids[5], ids[99]), (-4, -2)], "src long, dst long"))
    want = {i: min(ids) for i in ids} | {-4: -4, -2: -4}
    assert {r["node"]: r["component"] for r in common.extend_components(scratch, comp, links).collect()} == want and scratch.n == 4
    monkeypatch.setattr(common, "TASK_EDGES", 30)
    comp = common.connected_components(scratch, table)
    assert scratch.n > 6 and {r["node"]: r["component"] for r in common.extend_components(scratch, comp, links).collect()} == want


@pytest.mark.parametrize("centres", [False, True])
def test_bitmaps_give_all_pairs_of_small_buckets_and_centres_of_large_ones(centres):
    from labelflow.llm import similar

    rng = np.random.default_rng(8)
    base, sets = rng.integers(0, 1 << 52, 100, dtype=np.uint64), []
    for i in range(70):
        sets.append(rng.integers(0, 1 << 52, 100, dtype=np.uint64) if i % 7 == 0 else np.concatenate([base[:95], rng.integers(0, 1 << 52, 5, dtype=np.uint64)]))
    at = np.arange(0, 7001, 100)
    reps = [*range(10), *range(70)]
    t = {"key": [1] * 10 + [2] * 70, "rep": reps, "n": [100] * 80, "lab": [r // 2 for r in reps], "sig": [0] * 80}
    batch = pa.RecordBatch.from_arrays([*(pa.array(np.array(c)) for c in t.values()), bitmaps(np.concatenate(sets), at).take(pa.array(reps))], [*t, "bits"])
    order = rng.permutation(80)
    got = [p for b in similar._bucket_pairs(80, centres)([batch.take(pa.array(order[:30])), batch.take(pa.array(order[30:]))]) for p in zip(*(c.to_pylist() for c in b.columns))]
    alike = lambda a, b: a // 2 != b // 2 and a % 7 and b % 7
    every = {p for p in itertools.combinations(range(70), 2) if alike(*p)}
    small = {p for p in every if p[1] < 10}
    assert len(got) == len(set(got)) and small <= set(got) <= every
    assert set(got) == every if not centres else len(set(got) - small) <= (1 + similar.CENTRES) * 69


def test_band_keys_are_packed_by_key_and_salt():
    """A row for each part and PACK lines, not one for each of ten keys of a line; each key and salt has one part."""
    from labelflow.llm import line_dedup

    rng = np.random.default_rng(1)
    n = line_dedup.PACK + 5000
    t = {"h": rng.integers(-(1 << 62), 1 << 62, n), "sig": rng.integers(0, 9, n)} | {k: rng.integers(-3000, 50_000, n) for k in line_dedup.KEYS}
    t["b0"][:5000] = 7
    rows = pa.RecordBatch.from_arrays([pa.array(v) for v in t.values()], list(t))
    out = list(line_dedup._packer([(-5, 2), (7, 9)], 13)([rows.slice(i, 10_000) for i in range(0, n, 10_000)]))
    assert sum(b.num_rows for b in out) == 2 * 13
    parts, got = {}, []
    for part, data in ((p, x) for b in out for p, x in zip(b.column(0).to_pylist(), line_dedup._unpacked([b]))):
        got.append(np.stack([c.to_numpy() for c in data.columns], 1))
        assert all(parts.setdefault(tuple(k), part) == part for k in got[-1][:, [0, 3]].tolist())
    got, want = np.concatenate(got), np.stack([np.concatenate([t[k] for k in line_dedup.KEYS]), *(np.tile(t[c], 10) for c in ("h", "sig"))], 1)
    assert (got[np.lexsort(got[:, :3].T), :3] == want[np.lexsort(want.T)]).all()
    assert [len(set(got[got[:, 0] == k, 3].tolist())) for k in (-5, 7)] == [2, 9] and (got[(got[:, 0] != -5) & (got[:, 0] != 7), 3] == -1).all()


@pytest.mark.parametrize("at_most", [1 << 22, 0])
def test_large_buckets_give_fewer_links_than_members(at_most, monkeypatch):
    """Links within buckets join what all similar pairs join, and are no more than the members; too large ones give their near pairs to be confirmed."""
    from labelflow.llm import similar

    monkeypatch.setattr(similar, "BUCKET_BYTES", at_most)
    rng = np.random.default_rng(3)
    bases = [rng.integers(0, 1 << 52, 100, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([bases[i % 3][rng.permutation(100)[:92]], rng.integers(0, 1 << 52, int(rng.integers(2, 9)), dtype=np.uint64)])) for i in range(300)]
    reps = [*range(120), *range(40, 300)]  # a bucket may span batches
    t = {"key": [1] * 120 + [2] * 260, "rep": reps, "n": [len(sets[r]) for r in reps], "lab": [r // 2 for r in reps], "sig": [0] * len(reps)}
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    payload = pa.array([sets[r].view(np.int64) for r in reps], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([*(pa.array(np.array(c)) for c in t.values()), bitmaps(flat, at).take(pa.array(reps)), payload], [*t, "bits", "payload"])

    def sets_of(column):
        return column.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(column.value_lengths().to_numpy()))

    got = [tuple(r.values()) for b in similar._bucket_links(80, sets_of)([batch.slice(i, 100) for i in range(0, len(reps), 100)]) for r in b.to_pylist()]
    alike = lambda a, b: 100 * len(common := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(common))
    together = [p for p in itertools.combinations(range(300), 2) if (p[1] < 120 or p[0] >= 40)]
    every = {p for p in together if p[0] // 2 != p[1] // 2 and alike(*p)}
    own = [(2 * k, 2 * k + 1) for k in range(150)]
    if at_most:
        assert not any(o for *_, o in got) and len(got) < len(reps) and {(a, b) for a, b, _ in got} <= every
        assert components(range(300), own + [(a, b) for a, b, _ in got]) == components(range(300), own + list(every)) and len(every) > 2000
    else:
        assert all(o for *_, o in got) and every <= {(a, b) for a, b, _ in got}


@pytest.mark.parametrize("at_most", [1 << 22, 500])
def test_similar_lines_of_large_buckets_are_confirmed_in_tasks(spark, monkeypatch, at_most):
    """Lines that share band keys in large buckets are joined as by brute force, confirmed in the task or outside it."""
    from labelflow.llm import line_dedup, similar
    from labelflow.llm.common import Scratch

    monkeypatch.setattr(similar, "BUCKET_BYTES", at_most)
    rng = random.Random(4)
    base = [f"word{rng.randrange(10**6)}" for _ in range(30)]
    lines = [" ".join(w if rng.random() > 0.04 else f"other{rng.randrange(10**6)}" for w in base) for _ in range(120)]
    flat, at = line_dedup.line_sets(pa.array(lines))
    sets = [set(flat[at[k] : at[k + 1]].tolist()) for k in range(120)]
    words = [tuple(x[f"w{k}"] for k in range(similar.WORDS)) for x in bitmaps(flat, at).to_pylist()]
    scratch = Scratch(spark)
    rows = spark.createDataFrame([(i, len(s), w, x) for i, (s, w, x) in enumerate(zip(sets, words, lines))], f"rep long, n long, bits {similar.BITMAP}, payload string")
    buckets = scratch.save(rows.selectExpr("1L as key", "rep", "0L as sig"))
    met = scratch.save(rows.where("rep > 0").selectExpr("rep as src", "0L as dst", "1L as times"))
    got = similar.similar_components(scratch, met, buckets, scratch.save(rows), 80, line_dedup.confirm_lines, line_dedup.shingle_arrays, sets_of=line_dedup.line_sets)
    got = {r["node"]: r["component"] for r in got.collect()}
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {i: got.get(i, i) for i in range(120)} == components(range(120), links) and len(links) > 200


def test_band_keys_of_a_task_are_bounded_with_few_shuffle_partitions(spark, monkeypatch):
    from types import SimpleNamespace

    from labelflow.llm import line_dedup

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda rows: line_dedup._key_parts(SimpleNamespace(sparkSession=spark, counts={"rows": rows}))
    assert parts(0) == parts(1000) == few
    assert 10 * 30_000_000 / parts(30_000_000) <= line_dedup.TASK_KEYS
    monkeypatch.setattr(line_dedup, "TASK_KEYS", 20)
    d = spark.createDataFrame([(i, f"the same line of text\nline number {i * 7919 % 101} {i * i}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in drop_similar_lines(d).collect()}
    monkeypatch.undo()
    assert got == {r["doc_id"]: r["text"] for r in drop_similar_lines(d).collect()}
