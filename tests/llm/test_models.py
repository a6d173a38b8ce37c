"""Learned operators by held-out accuracy; search by recall; packing, mixing, licences and URLs by definition."""

import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelflow.llm import ann, language_id, license_scan, mixing, packing, queries, toxicity, url_filter

DIR = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_accuracy(spark):
    out = {r["doc_id"]: r for r in queries.op5_language_id(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()
    held = [d for d in docs if crc(d["doc_id"], 4) == 2]
    assert all(out[d["doc_id"]]["held_out"] for d in held) and len(out) == len(docs)
    assert np.mean([out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.98


def language_by_sets(train, texts):
    """(language, score) of each text by exact sets of grams: no filters, no arrays."""

    def grams(text):
        b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text} ".lower().encode()]
        b = [c for k, c in enumerate(b) if c != 32 or k == 0 or b[k - 1] != 32]
        return [tuple(b[i : i + n]) for n in language_id.GRAMS for i in range(len(b) - n + 1) if 32 not in b[i + 1 : i + n - 1]]

    code = lambda g: int.from_bytes(bytes([len(g), *g]), "big")
    count, rows = {}, {}
    for lang, text in train:
        rows[lang] = rows.get(lang, 0) + 1
        for g in grams(text):
            own = count.setdefault(lang, {})
            own[g] = own.get(g, 0) + 1
    order = sorted(rows, key=lambda x: (-rows[x], x))
    first = {x: sorted(count[x], key=lambda g: (-count[x][g], code(g)))[: 2 * language_id.FILTER_GRAMS] for x in order}
    rate = {x: {g: count[x][g] / sum(count[x].values()) for g in first[x]} for x in order}
    best = {}
    for x in order:
        for g, r in rate[x].items():
            best[g] = max(best.get(g, 0), r)
    sets = {x: set([g for g in first[x] if rate[x][g] >= language_id.SHARE * best[g]][: language_id.FILTER_GRAMS]) for x in order}
    out = []
    for t in texts:
        own = grams(t or "")
        hits = [sum(g in sets[x] for g in own) for x in order]
        some = any(c.isalpha() for c in t or "")
        out.append((order[hits.index(max(hits))], max(hits) / max(1, len(own)), sorted(hits)[-2:]) if some else ("und", 0.0, [0, 9**9]))
    return out


def test_languages_equal_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    train = [(r["lang"], r["text"]) for r in rows if crc(r["doc_id"], 4) != 2]
    texts = [r["text"] for r in rows] + ["the und de", "12 ?", "", None, "x", "der the la le"]
    f = language_id.learn(docs.where(queries._part("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f).collect()}
    for k, (lang, score, top) in enumerate(language_by_sets(train, texts)):
        assert abs(got[k]["score"] - score) < 0.03, texts[k]
        if top[1] - top[0] > 0.03 * max(1, top[1]):  # else corrected hits may order what is as good as equal
            assert got[k]["lang_pred"] == lang, texts[k]


def test_languages_and_grammars_of_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", 0.5, "x"), (2, None, None, 0.1, "y")], "doc_id long, text string, lang string, score double, predicted string")
    f = language_id.learn(docs)
    assert language_id.identify(docs.limit(0), f).collect() == [] and language_id.learn(docs.limit(0)) is None
    assert [r["lang_pred"] for r in language_id.identify(docs, f).orderBy("doc_id").collect()] == ["en", "und"]
    g = toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), g).collect() == [] and len(toxicity.score(docs, g).collect()) == 2
    long = spark.createDataFrame([(k, "the same words again and again " * 20_000) for k in (1, 2)], "doc_id long, text string")
    assert {r["lang_pred"] for r in language_id.identify(long, f).collect()} == {"en"}
    tie = language_id.learn(spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a")], "doc_id long, text string, lang string"))
    assert language_id.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), tie).first()["lang_pred"] == "a"


def test_language_edges(spark):
    train = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("the cat sat on the mat and the hat", "en"), ("der hund und die katze sind hier", "de")] * 4 + [("x", None)])], "doc_id long, text string, lang string")
    f = language_id.learn(train)
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "THE CAT"), (5, "und die"), (6, "я"), (None, "the")]
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), f).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")] and got[5][1] in ("en", "de") and got[6] == (None, "en")
    none = language_id.learn(train.where("lang = 'xx'"))
    assert none is None and language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), none).where("lang_pred <> 'und'").count() == 0
    kept = language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), f).collect()
    assert {r["doc_id"] for r in kept} >= {4, 5} and not {1, 2, 3} & {r["doc_id"] for r in kept}


def test_bloom_filters_hold_what_they_were_given():
    grams = {"a": np.arange(1, 4000, dtype=np.uint64) * np.uint64(977), "b": np.arange(1, 4000, dtype=np.uint64) * np.uint64(1_000_003)}
    f = language_id.LanguageFilters(grams, ["a", "b"])
    total, hits = f.counts([(grams["a"], np.zeros(3999, np.int64))], 1)
    assert total[0] == 3999 and hits[0, 0] > 3998 and hits[0, 1] < 20


def test_every_language_gets_a_filter(spark):
    rng = np.random.default_rng(7)
    words = {f"l{k:03}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(12)] for k in range(140)}
    f = language_id.learn(spark.createDataFrame([(i, " ".join(w), n) for i, (n, w) in enumerate(words.items())], "doc_id long, text string, lang string"))
    assert f.languages == sorted(words)
    docs = spark.createDataFrame([(n, " ".join(w[3:9])) for n, w in words.items()], "doc_id string, text string")
    assert all(r["lang_pred"] == r["doc_id"] and r["score"] > 0.9 for r in language_id.identify(docs, f).collect())
    assert language_id.keep_identified(docs, f, 0.9).count() == len(words)


def test_toxicity_accuracy(spark):
    out = {r["doc_id"]: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if crc(r["doc_id"], 5) == 0]
    assert all(out[r["doc_id"]]["held_out"] for r in labels)
    toxic = [out[r["doc_id"]]["predicted"] for r in labels if r["toxic"]]
    clean = [out[r["doc_id"]]["predicted"] for r in labels if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def by_patterns(steps):
    """The grammar read by regular expressions over the string of word classes: [(threat, aimed, negated, reported, weight)]."""
    t = toxicity
    text = "".join({t.OTHER: "o", t.INSULT: "I", t.THREAT: "V", t.TARGET: "T", t.NEGATION: "n", t.REPORT: "R", t.INTENSE: "s", t.MODAL: "m", t.LINK: "l", t.OBJECT: "C"}[x] for x, _ in steps)
    out = []
    for m in re.finditer("I(?:l{0,2}I)*", text):
        first, last = m.start(), m.end()
        weight = sum(w for x, w in steps[first:last] if x == t.INSULT)
        if first and text[first - 1] == "s":
            weight += (t.STRONG - 1) * steps[first][1]
        after = text[last : last + 3].split("I")[0]
        out.append((False, bool(re.search("[TC]", text[max(0, first - 3) : first] + after)), "n" in text[max(0, first - 3) : first], "R" in text[:first], weight))
    for m in re.finditer("V", text):
        at = m.start()
        after = text[at + 1 : at + 4].split("V")[0]
        before = text[max(0, at - 3) : at]
        behind = "m" in before and ("C" in before or "T" in before[before.rfind("m") :])
        if behind or re.search("[TC]", after) or "m" in before:
            out.append((True, behind or bool(re.search("[TC]", after)), "n" in text[max(0, at - 3) : at], "R" in text[:at], steps[at][1]))
    return out


def test_composition_equals_patterns():
    rng = np.random.default_rng(3)
    words = {"i1": (toxicity.INSULT, 1.0), "i2": (toxicity.INSULT, 0.6), "v1": (toxicity.THREAT, 0.9)}
    g = toxicity.Grammar(words, {})
    pool = ["i1", "i2", "v1", "you", "te", "not", "said", "so", "will", "of", "the", "tree", "house"]
    for _ in range(6000):
        clause = [pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 14))]
        got, want = np.zeros(toxicity.FEATURES), np.zeros(toxicity.FEATURES)
        g.clause(clause, got)
        for threat, aimed, negated, reported, weight in by_patterns([g.lexeme(w) for w in clause]):
            want[toxicity.channel(threat, aimed, negated, reported)] += weight
        assert np.allclose(got, want), clause


def test_fitted_weights_keep_the_order_of_the_grammar(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    g = toxicity.learn(docs, labels.where(queries._part("doc_id", 5) != 0))
    score = lambda t: float(g.score(g.channels(t)[None, :])[0])
    for threat in ("I will kill you", "we will burn your house", "ich werde dich töten", "je vais te tuer", "te voy a matar"):
        assert score(threat) >= 0.5, threat
    for aimed, plain in (("you are an idiot", "an idiot"), ("du bist ein idiot", "ein idiot"), ("tu es un crétin", "un crétin"), ("tú eres un estúpido", "un estúpido")):
        assert score(aimed) >= 0.5 > score(plain) > score("a fine day")
    assert score("you are not an idiot") < 0.5 and score("The word idiot appears in the dictionary.") < 0.5
    assert score("he said: an idiot") < score("an idiot") and score("they said i will kill you") < score("i will kill you")


def test_grammar_reads_clauses():
    g = toxicity.Grammar(toxicity.seed_words(), {"schwein": (toxicity.INSULT, 1.0)})
    score = lambda t: float(g.score(g.channels(t)[None, :])[0])
    assert score("you are an idiot") > score("an idiot. nothing") > score("it is not an idiot") > score("a fine day")
    assert score("so worthless, scum of the idiots idiot") > score("worthless day") and score("schweinehund here") > score("a fine day")
    assert score("i will kill you") > score("they said i will kill you") > score("a kill switch") == score("a fine day")
    assert g.channels("du bist ein idiot")[4] and g.channels("idiot, you")[4] and g.channels("pas un idiot")[2] and g.channels("dijo idiot")[1]
    assert g.channels("kill them")[12] and g.channels("we will kill it now")[8] and not g.channels("kill it now").any()
    assert not g.channels(None).any() and not g.channels("").any() and not g.channels("idiotic").any() and g.channels("x " * 90000 + "idiot").any()


def test_clauses_are_read_whole():
    g = toxicity.Grammar(toxicity.seed_words(), {"schwein": (toxicity.INSULT, 1.0)})
    long = "na " * 300
    for text in (f"she wrote {long}idiot", f"idiot {long}moron", f"idiot {'na ' * 65}na moron", f"never {long}you idiot {long}she said {long}scum; not moron", f"idiot {'x' * 900}schwein", f"idiot {long}. you idiot"):
        want = np.zeros(toxicity.FEATURES)
        for clause in toxicity.END.split(text):
            g.clause(toxicity.WORD.findall(clause), want)
        assert np.array_equal(g.channels(text)[: toxicity.CHANNELS], want[: toxicity.CHANNELS]), text
    assert g.channels(f"he reported that {long}idiot")[1] == 1
    assert [g.channels("idiot " + "z" * k + " moron")[0] for k in range(185, 205)] == [2.0] * 20
    assert g.lexeme("schwein" + "e" * 10**6)[0] == toxicity.INSULT


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "you idiot")], "doc_id long, text string")
    g = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, g).collect()
    assert len(got) == 4 and got[0]["score"] == got[1]["score"] < 0.5 and 0 <= min(r["score"] for r in got)


def test_nearest_neighbours(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest(d, d.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = d.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - x[i] @ x[np.flatnonzero(ids == m[1])[0]]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & set(ids[np.argsort(-s)[:20]]))
        total += 20
    assert hit / total >= 0.9


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>, shard int"
    rows = [(1, [1.0, 0.0], 1), (2, [5.0, 0.0], 1), (3, [5.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [-1.0, 3.0], 1), (9, [1.0, 2.0, 3.0], 1), (10, [3.0, 2.0, 1.0], 1)]
    d = spark.createDataFrame(rows, schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(d, d.where("vec_id in (1, 4, 9)"), k=20).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 5.0), (1, 2, 3, 5.0), (1, 3, 8, -1.0), (9, 1, 10, 10.0)]
    assert ann.nearest(d.limit(0), d.limit(0)).collect() == []


def test_nearest_doubles_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 20)
    d = spark.createDataFrame([(1, [16777217.0, 0.0]), (2, [1.0, 0.0])] + [(i, [0.5, 0.5]) for i in range(10, 90)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(d, d.where("vec_id = 2"), k=5).orderBy("rank").collect()]
    assert got == [(1, 16777217.0), *((i, 0.5) for i in range(10, 14))]


def test_probing_reads_few_of_many_rows():
    """Rows that have near neighbours: the radius ends early, and hardly any bucket is read."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((1000, 48))
    x = centres[rng.integers(0, 1000, 60000)] + 0.2 * rng.standard_normal((60000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 600)
    coder = ann.fit(x[rng.permutation(len(x))[:8192]], 128, 20, 0.96, 3)
    found, listed = ann.search(x, ids, x[asked], ids[asked], coder, 20)
    hit = 0
    for (rows, scores), i in zip(found, asked):
        s = x @ x[i]
        s[i] = -np.inf
        assert i not in rows and np.array_equal(scores, (x[rows] * x[i]).sum(1)) and (np.diff(scores) <= 0).all()
        hit += len(set(rows) & set(np.argpartition(-s, 20)[:20]))
    assert hit / (20 * len(asked)) >= 0.9 and listed.max() < 0.2 * len(x)


def test_substring_index_finds_every_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 5), dtype=np.uint16)
    codes[100:200] = codes[5] ^ (1 << rng.integers(0, 16, (100, 5)).astype(np.uint16)) * (rng.random((100, 5)) < 0.6).astype(np.uint16)
    index = ann.SubstringIndex(codes)
    for r in (0, 1, 3, 9, 25, 33):
        q = codes[5] ^ np.uint16(1)
        assert set(index.within(q, r)) == set(np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= r))


def test_packing(spark):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = [None, "", "Hello, World's end! It'll do.", "ÀÉ ß 12½ — “q”", "İstanbul ΣΑΣ", "日本語 text", "a b c\x1fd", "é café", "<|endoftext|>", "a <|endoftext|> b", "a <|ENDoftext|>", "don't 'S x", "word " * 9000, "x" * 20000]
    d = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    cut = packing.pieces(d, path, 4096, 1, keep_ids=True)
    rows = packing.pack(cut).collect()
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted({(r["piece"], r["start"], tuple(r["ids"]), r["ids_crc32"]) for r in rows if r["doc_id"] == i})
        assert [x for m in mine for x in m[2]] == want and [m[1] for m in mine] == list(range(0, len(want), 4096))
        assert all(m[3] == zlib.crc32(np.array(m[2], "<u4").tobytes()) for m in mine)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0) and r["length"] == len(r["ids"])
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096 and len(rows) == sum(1 for r in rows) and packing.sequences(packing.pack(cut)).count() == len(fill)
    assert packing.pack(packing.pieces(d.limit(0), path)).collect() == []


def test_new_words_of_many_texts_are_encoded_in_one_call(monkeypatch):
    enc, calls = packing.WordEncoder(queries.tokenizer_path()), []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda words: (calls.append(len(words)), learn(words)))
    texts = [f"Some {w} words\nof {w}{k}'s" for k, w in enumerate(["blorp", "zanth", "", "qu"] * 50)] + ["日本語 text", ""]
    got = enc.encode(texts)
    assert [list(np.frombuffer(g, "<u4")) for g in got] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and enc.encode(texts) == got and len(calls) == 1


def test_sum_of_squares():
    b = packing.sum_of_squares(np.array([6, 4, 6, 4, 10, 5, 5]), 10)
    load = np.bincount(b, [6, 4, 6, 4, 10, 5, 5])
    assert len(load) == 4 and (load == 10).all()
    sizes = np.sort(np.random.default_rng(0).integers(1, 300, 3000))[::-1]
    assert len(np.unique(packing.sum_of_squares(sizes, 512))) <= np.ceil(sizes.sum() / 512) * 1.01 + 1


def test_packing_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.integers(1, 200, 700))], "doc_id long, text string")
    rows = packing.pack(packing.pieces(d, queries.tokenizer_path(), 256), 256).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert len(rows) == 700 and max(fill.values()) <= 256 and len(fill) <= sum(fill.values()) / 256 * 1.03 + 1


def test_mixing(spark):
    words = lambda n, s: " ".join(f"{s}{i}" for i in range(n))
    rows = [(i, words(50 + i % 90, "w"), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(900, None, "s0"), (901, "", "s1"), (902, " \n", None), (5, words(55, "w"), "s1"), (5, words(55, "w"), "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as sid", "2 as size")
    m = mixing.mix(d)
    taken = m.taken().collect()
    assert len(taken) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in taken)
    by = {}
    for r in taken:
        t = by.setdefault((r["source_size"], r["target"]), [0])
        t[0] += r["taken"]
    total = sum(s for s, _ in by)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 and all(abs(v[0] - t) <= 2 * mixing.BLOCK for (_, t), v in by.items())
    assert sorted(m.taken().collect()) == sorted(mixing.mix(d).taken().collect())
    assert m.draws.agg({"c": "sum"}).first()[0] == m.slots.count() and sum({r["source_size"]: r["drawn"] for r in taken}.values()) == m.slots.count()
    counts = m.slots.groupBy("sid").count().collect()
    assert {r["sid"]: r["count"] for r in counts} == {r["sid"]: r["quota"] for r in m.sources.collect() if r["quota"]}
    assert m.slots.select("shard", "slot").distinct().count() == m.slots.count()
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    got = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in out.collect())
    assert got == sum(r["taken"] for r in taken)
    assert mixing.mix(d.limit(0)).taken().collect() == [] and mixing.mixed_documents(d.limit(0)).collect() == []


def test_permutations(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000, 4099):
        d = spark.range(n).select("id", *[mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(17), F.lit(s), F.lit(t)).alias(f"p{s}{t}") for s, t in ((1, 0), (1, 1), (2, 0))])
        rows = d.orderBy("id").collect()
        for c in ("p10", "p11", "p20"):
            assert sorted(r[c] for r in rows) == list(range(n))
        if n >= 1000:
            p = np.array([r["p10"] for r in rows])
            assert len(np.unique(np.diff(p) % n)) > n // 4 and (p != np.array([r["p11"] for r in rows])).mean() > 0.9 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.15


def test_small_sources_meet_their_targets(spark):
    rows = [(100 * k + i, "w " * (5 + k % 3), f"s{k:02}") for k in range(12) for i in range(20)]  # 100 to 140 words each
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect()
    by = {}
    for r in out:
        by.setdefault((r["source_size"], r["target"], r["doc_id"] // 100), []).append(r["taken"])
        assert r["taken"] <= 2 * r["size"]
    assert len(by) == 12 and all(abs(sum(v) - target) <= 0.02 * target for (_, target, _), v in by.items())


def test_water_level(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(s).collect()}
    # a stops at 200; the rest of 3150 goes 2 : 1 to b and c until b stops at 2000
    assert got["a"] == (5.0, 200.0) and got["b"][0] == 2.0 and abs(got["b"][1] - 1966.6666666666667) < 1e-9 and abs(got["c"][1] - 983.3333333333334) < 1e-9 and got[None] == (5.0, 0.0)


def dice(a, b):
    grams = lambda t: set(zip(w := re.findall(r"[a-z0-9\u0080-￿]+", t.lower()), w[1:]))
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0


def best_licence(unit):
    values = [(round(dice(unit, t), 9), n) for n, t in license_scan.TEMPLATES]
    top = max(v for v, _ in values)
    return (top, " OR ".join(dict.fromkeys(n for v, n in values if v == top))) if top >= 0.8 else None


def scan_by_hand(text):
    """Every line, run of lines that mostly consist of template bigrams, and the whole text, each against every template; of those that
    overlap, that which has most in common."""
    grams = lambda t: list(zip(w := re.findall(r"[a-z0-9\u0080-\uffff]+", t.lower()), w[1:]))
    known = {g for _, t in license_scan.TEMPLATES for g in grams(t)}
    lines = (text or "").split("\n")
    spoken = [k for k, x in enumerate(lines) if re.search(r"[A-Za-z0-9\u0080-\uffff]", x)]
    units, run = {(k, k + 1) for k in spoken} | {(0, len(lines))}, []
    for k in [*spoken, None]:
        if k is not None and 2 * sum(g in known for g in grams(lines[k])) >= max(1, len(grams(lines[k]))):
            run.append(k)
            continue
        units |= {(run[0], run[-1] + 1)} if run else set()
        run = []
    found = []
    for a, e in units:
        unit = "\n".join(lines[a:e])
        if b := best_licence(unit):
            common = max(len(set(grams(unit)) & set(grams(t))) for _, t in license_scan.TEMPLATES if round(dice(unit, t), 9) == b[0])
            found.append((-common, -b[0], e - a, a, b[1]))
    out = []
    for _, d, n, a, name in sorted(found):
        if all(a + n <= x or a >= x + m for x, m, *_ in out):
            out.append((a, n, name, -d))
    return sorted(out)


BSD_FILE = """Copyright (c) 2020, Some One
All rights reserved.

{head}

* {one}

* {two}

{third}{tail}

int main() {{ return 0; }}
"""


def test_whole_licence_files_are_named_once():
    one, two = license_scan.BSD_TWO.removeprefix("1. ").split(" 2. ")
    scan = license_scan.Scanner()
    for name, third in (("BSD-3-Clause", f"* {license_scan.BSD_THIRD.removeprefix('3. ')}\n\n"), ("BSD-2-Clause", "")):
        text = BSD_FILE.format(head=license_scan.BSD_HEAD, one=one, two=two, third=third, tail=license_scan.BSD_TAIL.replace(". ", ".\n"))
        names = [which for _, n, which, _ in scan.scan(text.encode()) if n > 1]
        assert names == [name] and "BSD-2-Clause OR BSD-3-Clause" not in [which for _, _, which, _ in scan.scan(text.encode())]
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + license_scan.TEMPLATES[3][1].replace(". ", ".\n\n")
    assert [which for _, n, which, _ in scan.scan(mit.encode()) if n > 1] == ["MIT"]


def test_licences_equal_brute_force(spark):
    names = license_scan.TEMPLATES
    lines = [t for _, t in names] + ["Released under the MIT license", "this program is fine", "", "all rights", "RELEASED UNDER: THE MIT LICENSE!", "licensed under cc by nc 4 0 or so", "some other words that go on"]
    docs = [(i, f"first line here\n{x}\nlast words there") for i, x in enumerate(lines)] + [(100, None), (101, "")]
    docs += [(102 + k, t.replace(", ", ",\n").replace(". ", ".\n")) for k, (_, t) in enumerate(names)]
    docs += [(200, names[3][1].replace(" ", "\n")), (201, "x " * 30000 + "\n" + names[0][1]), (202, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + license_scan.TEMPLATES[3][1].replace(". ", ".\n"))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, license int")
    got = {}
    for r in license_scan.scan_licenses(d).collect():
        got.setdefault(r["doc_id"], []).append((r["first_line"], r["n_lines"], r["license"], round(r["dice"], 9)))
    for i, text in docs:
        assert sorted(got.get(i, [])) == scan_by_hand(text), text
    bsd = {n: next(i for i, (m, t) in enumerate(names) if m == n and len(t) > 800) for n in ("BSD-2-Clause", "BSD-3-Clause")}
    assert all([x[2] for x in got[i] if x[1] == 1] == [n] for n, i in bsd.items())
    head = next(i for i, (_, t) in enumerate(names) if t == license_scan.BSD_HEAD)
    assert got[head][0][2] == "BSD-2-Clause OR BSD-3-Clause"
    assert license_scan.scan_licenses(d.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op3_url_filter", "op7_source_mixing"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = queries.queries()[name](spark, DIR)
    want = con.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, df.collect())) and sorted([repr(v) for v in r] for r in df.collect()) == sorted([repr(r[i]) for i in order] for r in want.fetchall())


def test_url_filter_edges(spark):
    log = [("bad.com", "x", "add", 10), ("bad.com", "x", "add", 12), ("bad.com", "x", "remove", 20), ("bad.com", "x", "remove", 20), ("bad.com", None, "ADD", 30), ("a.org/p/q", "y", "add", 0), (None, "x", "add", 0), ("z.com", "x", "drop", 0), ("[2001:db8::1]", "x", "add", 0), ("10.0.0.1", "x", "add", 0), ("t.com", "x", "add", 5), ("t.com", "x", "remove", 5)]
    e = spark.createDataFrame(log, "key string, category string, action string, ts long")
    held = {(r["key"], r["category"], r["valid_from"], r["valid_to"]) for r in url_filter.intervals(e).collect()}
    assert held == {("bad.com", "x", 10, 20), ("bad.com", None, 30, None), ("a.org/p/q", "y", 0, None), ("[2001:db8::1]", "x", 0, None), ("10.0.0.1", "x", 0, None)}
    cap = [(1, "http://u:p@WWW.Bad.com:80/x", 15), (2, "http://bad.com", 20), (3, "http://bad.com", 9), (4, None, 15), (5, "/relative", 15), (6, "https://a.org/p/q/r?x", 1), (7, "https://a.org/p", 1), (8, "http://bad.com", None), (None, "http://bad.com/", 40), (9, "http://t.com", 5), (10, "http://[2001:DB8::1]:80/x", 15), (11, "http://10.0.0.1/", 15), (1, "http://u:p@WWW.Bad.com:80/x", 15)]
    got = url_filter.filter_captures(spark.createDataFrame(cap, "page_id long, url string, fetch_ts long").selectExpr("*", "1 as key", "2 as category"), e).collect()
    assert len(got) == len(cap) and sorted((r["page_id"] or 0) for r in got if r["blocked"]) == [0, 1, 1, 6, 10, 11]
    assert url_filter.filter_captures(spark.createDataFrame(cap, "page_id long, url string, fetch_ts long").limit(0), e).collect() == [] and url_filter.filter_captures(spark.createDataFrame(cap, "page_id long, url string, fetch_ts long"), e.limit(0)).where("blocked").count() == 0
    assert {r["list_key"] for r in got if r["page_id"] == 6} == {"a.org/p/q"}


def test_url_filter_keys_as_lists_write_them(spark):
    keys = {"a.org/Ads": "a.org/Ads", "b.org/": "b.org", "c.org/p/": "c.org/p", "D.org.": "d.org", "www.e.org:8080": "www.e.org", "https://U@F.org:1/x//y/?q#f": "f.org/x/y", " ": None, "/p": None}
    log = spark.createDataFrame([(k, "x", "add", 0) for k in keys], "key string, category string, action string, ts long")
    assert {r["key"]: r["k"] for r in log.select("key", url_filter.listed_key("key").alias("k")).collect()} == keys
    asked = {"http://a.org/Ads/1": True, "http://a.org/ads/1": False, "http://b.org/z": True, "http://c.org/p": True, "http://c.org/P": False, "http://x.d.org": True, "http://www.e.org/": True, "http://f.org/x/y/z": True, "http://f.org/x/": False}
    got = url_filter.filter_captures(spark.createDataFrame([(k, u, 5) for k, u in enumerate(asked)], "page_id long, url string, fetch_ts long"), log)
    assert {r["url"]: r["blocked"] for r in got.collect()} == asked


def test_url_filter_asks_every_depth(spark):
    host, path = ".".join(f"l{k}" for k in range(50)), "/".join(map(str, range(30)))
    domains = [".".join(host.split(".")[-k:]) for k in range(1, 51)]
    prefixes = [f"{host}/" + "/".join(path.split("/")[:k]) for k in range(1, 31)]
    url = f"http://{host}/{path}?q"
    asked = spark.createDataFrame([(url,)], "url string").select(url_filter.keys_of("url").alias("k")).first()["k"]
    assert sorted(asked) == sorted(domains + prefixes)
    keys = [domains[8], domains[40], prefixes[4], prefixes[20]]  # 9 and 41 labels, 5 and 21 parts
    for listed in keys:
        e = spark.createDataFrame([(listed, "x", "add", 0)], "key string, category string, action string, ts long")
        cap = spark.createDataFrame([(1, url, 5), (2, "http://l49/0", 5), (3, "http://l49", 5)], "page_id long, url string, fetch_ts long")
        got = {r["page_id"]: (r["blocked"], r["n_active"], r["list_key"]) for r in url_filter.filter_captures(cap, e).collect()}
        assert got == {1: (True, 1, listed), 2: (False, 0, None), 3: (False, 0, None)}


def test_language_grams_take_little_memory_at_once():
    """A batch of many texts is counted in small runs, as executors share their memory with workers; grams are those of the texts one by one."""
    texts = pa.array([f"words of text number {i} " * 40 for i in range(4000)])
    tracemalloc.start()
    n = sum(len(codes) for _, _, parts in language_id.gram_codes(texts) for codes, _ in parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len(codes) for t in texts.to_pylist() for _, _, parts in language_id.gram_codes(pa.array([t])) for codes, _ in parts)
    assert peak < 60e6
