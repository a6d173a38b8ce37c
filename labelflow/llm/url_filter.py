"""URL filters over time: dated list entries, validity intervals, as-of join.

A list is a log of entries (key, category, action add or remove, ts).  A key is a host or
domain, or a host with a path prefix.  Entries become intervals [valid_from,
valid_to) during which a key is listed; a capture is evaluated against those that
hold at its fetch time.  A capture asks for its host, every parent domain and
every path prefix at a slash; the join is an equi join on the key with the time
as a further condition, so it is dealt out by key, and Spark splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)"


def host_of(url: str | Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and a final dot; null if there is none.

    An IPv6 address keeps its brackets.  Addresses are keys like names; what is before a dot of theirs is no domain that anybody lists.
    """
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_parts(url: str | Column) -> Column:
    """The parts of an absolute URL's path between slashes, empty ones left out."""
    url = F.col(url) if isinstance(url, str) else url
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")


def keys_of(url: str | Column, label_depths: Column | None = None, part_depths: Column | None = None) -> Column:
    """The keys a URL is looked up by: host, parent domains, host with path prefixes.

    Arrays of depths, if given, leave only domains of so many labels and prefixes of so many parts.
    """
    url = F.col(url) if isinstance(url, str) else url
    host, parts = host_of(url), path_parts(url)
    labels = F.split(host, r"\.")
    none = F.array().cast("array<int>")

    def depths(n: Column, only: Column | None) -> Column:
        return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(none) if only is None else F.filter(only, lambda k: k <= n)

    domains = F.transform(depths(F.size(labels), label_depths), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    prefixes = F.transform(depths(F.size(parts), part_depths), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def listed_key(key: str | Column) -> Column:
    """A listed key in the form in which captures ask: host in lower case without scheme, user, port and final dot, then the
    path's parts, whose case counts, without empty ones, query and fragment; null if no host is left."""
    key = F.trim(F.col(key) if isinstance(key, str) else key)
    url = F.when(key.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), key).otherwise(F.concat(F.lit("x://"), key))
    return F.when(host_of(url).isNotNull(), F.array_join(F.concat(F.array(host_of(url)), path_parts(url)), "/"))


def depths_of(entries: DataFrame) -> DataFrame:
    """One row (label_depths, part_depths): numbers of labels of the listed domains, and of parts of the listed paths."""
    key = listed_key("key")
    parts = F.size(F.split(key, "/")) - 1
    return entries.agg(F.collect_set(F.when(parts == 0, F.size(F.split(key, r"\.")))).alias("label_depths"), F.collect_set(F.when(parts > 0, parts)).alias("part_depths"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of a log (key, category, action, ts).

    valid_to is null while a key is still listed.  Adding what is listed and removing what is
    not change nothing.  Of entries at one instant a removal counts last.  Entries with a
    null key, action or ts, or another action, are left out; a null category is one of
    its own.  Repeated entries change nothing.  Keys may be written as URLs; ``listed_key`` says what counts in them.
    """
    log = entries.select(listed_key("key").alias("key"), "category", F.lower("action").alias("action"), "ts").where("key is not null and ts is not null and action in ('add', 'remove')")
    log = log.groupBy("key", "category", "ts").agg(F.max("action").alias("action"))  # remove is after add
    order = Window.partitionBy("key", "category").orderBy("ts")
    log = log.withColumn("before", F.lag("action").over(order)).where("not (action <=> before)")
    log = log.withColumn("valid_to", F.lead("ts").over(order))
    return log.where("action = 'add'").select("key", "category", F.col("ts").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetch_ts") -> DataFrame:
    """(id, url, host, fetch time, blocked, n_active, list_key, category) of every capture.

    n_active counts the (key, category) pairs listed at the fetch time; list_key is the
    longest of them (the last in order among equals) and category its smallest category.  A null or relative
    URL, or a null time, matches nothing.  Rows that repeat are evaluated each; an id may be null.  Extra
    columns are ignored.  Without entries nothing is blocked; without captures the result is empty.
    """
    held = intervals(entries)
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    base = base.groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("copies"))
    # only depths that the list has: rows stay few, and no depth of it is left out
    deep = base.crossJoin(F.broadcast(depths_of(entries)))
    asked = deep.select("id", "url", "at", F.explode(keys_of("url", F.col("label_depths"), F.col("part_depths"))).alias("key"))
    hits = asked.join(held, "key").where((F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    one = hits.groupBy("id", "url", "at", "key").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("category"))
    found = one.groupBy("id", "url", "at").agg(F.sum("n").alias("n_active"), F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("category").alias("category"))).alias("best"))
    b, f = base.alias("b"), found.alias("f")
    out = b.join(f, F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.url") == F.col("f.url")) & (F.col("b.at") == F.col("f.at")), "left")
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, b.copies)")))
    return out.select(F.col("b.id").alias(id_col), F.col("b.url").alias(url_col), host_of(F.col("b.url")).alias("host"), F.col("b.at").alias(time_col), F.col("f.n_active").isNotNull().alias("blocked"), F.coalesce("f.n_active", F.lit(0)).cast("long").alias("n_active"), F.col("f.best.key").alias("list_key"), F.col("f.best.category").alias("category"))
