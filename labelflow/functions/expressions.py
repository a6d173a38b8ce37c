"""Column functions of the dataflow expression language that Spark has under another name or rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of durations in nanoseconds and of sizes in bytes (binary multiples).
DURATIONS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
SIZES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}


def duration(text: str) -> int:
    """Nanoseconds of a literal such as 10ms."""
    n, unit = re.fullmatch(r"(\d+)(ns|us|ms|s|m|h)", text).groups()
    return int(n) * DURATIONS[unit]


def size(text: str) -> int:
    """Bytes of a literal such as 64MB."""
    n, unit = re.fullmatch(r"(\d+)(B|KB|MB|GB)", text).groups()
    return int(n) * SIZES[unit]


def same(a: Column, b: Column) -> Column:
    """Equality of numbers of different types, compared as doubles."""
    return a.cast("double") == b.cast("double")


def or_else(value: Column, fallback: Column) -> tuple[Column, Column]:
    """(value or fallback where it fails, whether it failed)."""
    return F.coalesce(value, fallback), value.isNull()


def glob(c: Column, pattern: str) -> Column:
    """Whether a name matches a pattern of * and ?."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return c.rlike(f"^{body}$")


def config(c: Column) -> Column:
    """key=value;key=value as a map."""
    return F.str_to_map(c, F.lit(";"), F.lit("="))


def json_member(c: Column, path: str, kind: str) -> Column:
    """A member of a JSON text by a path such as a.b, null if absent or of another type."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{path}", kind)


def json_number(c: Column) -> Column:
    """NaN and infinities as null, as JSON encodes them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def nanos_text(ns: Column) -> Column:
    """A duration in the largest unit that divides it, e.g. 1500000 -> 1500us."""
    out = F.concat(ns.cast("string"), F.lit("ns"))
    for unit in ("us", "ms", "s", "m", "h"):
        out = F.when((ns != 0) & (ns % DURATIONS[unit] == 0), F.concat((ns / DURATIONS[unit]).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def entropy(p: Column) -> Column:
    """The aggregate -sum(p ln p) of probabilities."""
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def merged(first: Column, then: Column) -> Column:
    """Two maps as one object; where both have a key, ``then`` wins.  A null map counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(first, empty), F.coalesce(then, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def plus_duration(ns: Column, text: str, sign: int = 1) -> Column:
    """A number of nanoseconds plus, or minus, a duration literal."""
    return ns + F.lit(sign * duration(text))
