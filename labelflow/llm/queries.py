"""One query per operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, packing, toxicity, whitening
from .ann import nearest
from .collocation import collocations
from .embedding_dedup import near_duplicate_vectors
from .license_scan import scan_licenses
from .line_dedup import drop_similar_lines
from .minhash_dedup import near_duplicates
from .sharding import KEY_BITS, TOLERANCE, shard_records
from .url_filter import filter_captures, host_of, path_parts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all embeddings."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat or resemble an earlier one."""
    return drop_similar_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Fixed values of op3: seconds of 2024-01-01, of a day, and a log of dated entries.
START, DAY = 1704067200, 86400
LOG = [
    ("casino-win.example.com", "gambling", "add", 10),
    ("casino-win.example.com", "gambling", "remove", 150),
    ("casino-win.example.com", "gambling", "add", 240),
    ("free-bets.example.com", "gambling", "add", 0),
    ("free-bets.example.com", "spam", "add", 100),
    ("cheap-pills.example.com", "pharma", "add", 30),
    ("cheap-pills.example.com", "pharma", "remove", 300),
]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time made from page_id, in seconds; the table has none."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"{START} + pmod(page_id * 37, 366) * {DAY} + pmod(page_id * 101, {DAY})").alias("fetch_ts"))


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed log, and entries for hosts and path prefixes of the pages that come and go by the length of their names."""
    fixed = spark.createDataFrame([(k, c, a, START + DAY * d) for k, c, a, d in LOG], "key string, category string, action string, ts long")
    pages = _table(spark, sf_dir, "pages").select(host_of("url").alias("host"), path_parts("url").alias("parts")).where("host is not null")
    hosts = pages.select(F.col("host").alias("key"), F.lit("watch").alias("category")).where("length(key) % 3 = 0")
    paths = pages.where("size(parts) > 1").select(F.concat_ws("/", "host", F.slice("parts", 1, F.size("parts") - 1)).alias("key"), F.lit("section").alias("category")).where("length(key) % 4 = 0")
    n = F.length("key")
    moves = F.array(*[F.struct(F.lit(a).alias("action"), (START + DAY * (n * 5 % 90 + d)).cast("long").alias("ts")) for a, d in (("add", 0), ("remove", 120), ("add", 200))])
    # written as lists have them: hosts in capitals with dot, port and slash; every other path with a capital, which then is another path
    written = F.when(F.col("category") == "watch", F.concat(F.upper("key"), F.lit(".:8080/"))).when(n % 8 == 0, F.regexp_replace("key", "/([^/]*)$", "/X$1")).otherwise(F.col("key"))
    own = hosts.union(paths).distinct().select(written.alias("key"), "category", F.explode(moves).alias("m")).select("key", "category", "m.action", "m.ts")
    return fixed.union(own)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page evaluated against the entries active when it was fetched."""
    return filter_captures(captures(spark, sf_dir), dated_entries(spark, sf_dir))


_HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)', 1)), '\.$', '')"
OP3_SQL = f"""
with c as (select page_id, url, nullif({_HOST_SQL}, '') as host,
    ({START} + page_id * 37 % 366 * {DAY} + page_id * 101 % {DAY})::bigint as fetch_ts from pages),
parts as (select page_id, url, fetch_ts, host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as q from c where host is not null),
hosts as (select distinct host as key, 'watch' as category from c where host is not null and length(host) % 3 = 0
  union select distinct host || '/' || array_to_string(q[:len(q) - 1], '/') as key, 'section' from parts where len(q) > 1 and length(host || '/' || array_to_string(q[:len(q) - 1], '/')) % 4 = 0),
log as (
  select * from (values {", ".join(f"('{k}', '{c}', '{a}', {START + DAY * d}::bigint)" for k, c, a, d in LOG)}) v(key, category, action, ts)
  union all
  select case when category = 'section' and length(key) % 8 = 0 then regexp_replace(key, '/([^/]*)$', '/X\\1') else key end, category, action, {START} + {DAY} * (length(key) * 5 % 90 + d)
  from hosts, (values ('add', 0), ('remove', 120), ('add', 200)) m(action, d)),
l1 as (select key, category, ts, max(action) as action from log group by all),
l2 as (select *, lag(action) over (partition by key, category order by ts) as before from l1),
l3 as (select *, lead(ts) over (partition by key, category order by ts) as valid_to from l2 where action is distinct from before),
held as (select key, category, ts as valid_from, valid_to from l3 where action = 'add'),
labels as (select page_id, url, fetch_ts, string_split(host, '.') as p from c where host is not null),
asked as (
  select page_id, url, fetch_ts, array_to_string(p[k:], '.') as key from (select *, unnest(range(1, len(p) + 1)) as k from labels)
  union select page_id, url, fetch_ts, host || '/' || array_to_string(q[:k], '/') from (select *, unnest(range(1, len(q) + 1)) as k from parts)),
one as (select page_id, key, count(*) as n, min(category) as category from asked join held using (key)
  where fetch_ts >= valid_from and (valid_to is null or fetch_ts < valid_to) group by all),
found as (select page_id, sum(n)::bigint as n_active, max({{'n': length(key), 'key': key, 'category': category}}) as best from one group by page_id)
select c.page_id, c.url, c.host, c.fetch_ts, n_active is not null as blocked, coalesce(n_active, 0)::bigint as n_active,
  best.key as list_key, best.category as category
from c left join found using (page_id)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def _part(name: str, n: int):
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grammar = toxicity.learn(docs, labels.where(_part("doc_id", 5) != 0))
    out = toxicity.score(docs, grammar)
    return out.select("doc_id", (_part("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    filters = language_id.learn(docs.where(_part("doc_id", 4) != 2))
    out = language_id.identify(docs, filters)
    return out.select("doc_id", (_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    """The vocabulary that op6 counts in, from the installed files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1), capacity=4096)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 5, 2, 1 to 150 % of their words."""
    return mixing.mix(_table(spark, sf_dir, "documents")).taken()


def _random_sql(*parts: str) -> str:
    y, p = f"((x + p) % {mixing.PRIME})", mixing.PRIME
    return f"list_reduce([1::bigint, {', '.join(f'(({part}) % {p})::bigint' for part in parts)}, 1, 2], lambda x, p: ({y} * {y} % {p} * {mixing.BY} + p + {mixing.PLUS}) % {p})"


def _feistel_sql(seed: int) -> str:
    """Nested selects that turn x once in each round; l and r are the coordinates."""
    out = "select *, x % a as l, x // a as r from walk where x >= n or not begun"
    for k in range(mixing.ROUNDS):
        one, other, mod = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        out = f"select * exclude ({one}), ({one} + {_random_sql(str(seed), 'sid', 'turn', str(k), other)}) % {mod} as {one} from ({out})"
    return out


OP7_SEED = 17
OP7_SQL = f"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as sid from s),
s2 as (select *, list_extract([5.0, 2.0, 1.0], (sid - 1) % 3 + 1)::double as weight, 2.0::double * source_size as cap from s1),
s3 as (select *, cap / weight as full_at,
    coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as rest,
    1.5::double * sum(source_size) over () as total from s2),
s4 as (select *, max(case when (total - before) / rest <= full_at then (total - before) / rest end) over () as level from s3),
s5 as (select source, source_size, sid, coalesce(least(cap, level * weight), cap) as target, width, ceil(source_size / width::double)::bigint as n_blocks
    from (select *, greatest(1, least({mixing.BLOCK}, source_size // {mixing.FINE}))::bigint as width from s4)),
s6 as (select *, case when source_size > 0 then round(target * n_blocks / source_size) else 0 end::bigint as quota from s5),
ed as (select sid, quota, sum(quota) over (order by sid)::bigint as hi from s6 where quota > 0),
al as (select unnest(range(max(hi))) as slot, max(hi) as total from ed),
u as (select ({_random_sql(str(OP7_SEED), 'slot')} * 2147483648::bigint + {_random_sql(str(OP7_SEED + 1), 'slot')}) % total as u from al),
dr as (select sid, count(*) as drawn from u join ed on u >= hi - quota and u < hi group by sid),
slots as (select sid, n_blocks, unnest(range(quota)) as k from s6),
walk as (
  select sid, k // n_blocks as turn, k, n_blocks as n, ceil(sqrt(n_blocks))::bigint as a, ceil(n_blocks / ceil(sqrt(n_blocks)))::bigint as b, k % n_blocks as x, false as begun from slots
  union all
  select sid, turn, k, n, a, b, (r * a + l)::bigint as x, true from ({_feistel_sql(OP7_SEED)})),
times as (select sid, x as block, count(*) as times from walk where begun and x < n group by all),
p as (select doc_id, size, sid, source_size, target, width,
    sum(size) over (partition by sid order by doc_id, size rows unbounded preceding)::bigint - size as start,
    row_number() over () as row_no
  from d join s6 on d.source is not distinct from s6.source),
seg as (select row_no, sid, start, size, width, unnest(range(start // width, (start + size - 1) // width + 1)) as block from p where size > 0),
t as (select row_no, sum((least((block + 1) * width, start + size) - greatest(block * width, start)) * times)::bigint as taken
  from seg join times using (sid, block) group by row_no)
select doc_id, size, source_size, target, coalesce(drawn, 0)::bigint as drawn, coalesce(taken, 0)::bigint as taken from p left join t using (row_no) left join dr using (sid)
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8, over all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


SHARDS = 16


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = shard_records(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_KEY_SQL = f"('0x' || substr(md5({{}}), 1, {KEY_BITS // 4}))::bigint"
#: CRC-32 has no function here: bits of a byte, then bytes of a text, folded by the polynomial.
OP11_SQL = f"""
with steps as (select list(v order by i) as fold from (
    select range as i, list_reduce(list_prepend(range::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)::bigint as v from range(256))),
d as (select doc_id, coalesce(text, '') as t from documents),
r as (select doc_id, (strlen(t) + 1)::bigint as size, {_KEY_SQL.format("t")} as h, {_KEY_SQL.format("coalesce(doc_id::varchar, '')")} as g,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::bigint)),
      lambda c, b: xor(c >> 8, fold[(xor(c, b) & 255) + 1])), 4294967295)::bigint as text_crc32 from d, steps),
p as (select *, (sum(size) over (order by h, g rows unbounded preceding))::bigint - size as start, row_number() over (order by h, g) as rank, (sum(size) over ())::bigint as total from r),
c as (select unnest(range(1, {SHARDS})) as cut),
x as (select cut, h, total from p, c where start * {SHARDS} <= cut * total and cut * total < (start + size) * {SHARDS}),
gr as (select h, 2 * {SHARDS} * min(start) as lo, 2 * {SHARDS} * max(start + size) as hi from p group by h),
k as (select case when (hi - lo) * {TOLERANCE} > 2 * total then 2 * cut * total when 2 * cut * total - lo < hi - 2 * cut * total then lo else hi end as pos from x join gr using (h)),
s as (select *, (select count(*) from k where pos <= 2 * {SHARDS} * start + {SHARDS} * size) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard::int as shard, rank - min(rank) over (partition by shard) as slot, null::int as grown_shard from s
"""


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of all embeddings."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=32)
    if model is None:
        return spark.createDataFrame([], WHITENED)
    error = model.identity_error(vectors)
    out = model.transform(vectors, deviation="deviation").where("whitened is not null").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(_table(spark, sf_dir, "documents"), least=30, top=2000)


OP13_SQL = """
with pieces as (
  select lang, row_number() over () as id, p as piece from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
w as (select lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda x: x <> '') as w from pieces),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m) group by all),
n as (select lang, sum(f)::bigint as n from g where m = 1 group by lang),
c as (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from g where m > 1 and f >= 30),
cut as (select lang, m, phrase, a, k, array_to_string(w[:k], ' ') as lp, array_to_string(w[k + 1:], ' ') as rp from (select *, unnest(range(1, m)) as k from c)),
sc as (select cut.lang, cut.phrase, a, k, gl.f as l, gr.f as r, (2000000::hugeint * a // (gl.f + gr.f))::bigint as score
  from cut join g gl on gl.lang = cut.lang and gl.phrase = lp join g gr on gr.lang = cut.lang and gr.phrase = rp),
lo as (select *, row_number() over (partition by lang, phrase order by score, k) as pick from sc),
sub as (select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(a) as longest from (
  select lang, w, s, a, unnest(range(1, m - s + 2)) as i from c, (select unnest([2, 3]) as s) where s < m) group by all),
kept as (select lo.* from lo left join sub using (lang, phrase) where pick = 1 and (longest is null or 100 * longest::hugeint < 80 * a::hugeint)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_source_mixing": op7_source_mixing,
        "op8_license_scan": op8_license_scan,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_sharding": op11_sharding,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op7_source_mixing": OP7_SQL, "op11_sharding": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
