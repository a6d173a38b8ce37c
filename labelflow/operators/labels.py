"""Label lattices as bit masks, and label operations as Column expressions.

A label is a name in a string column.  ``up(x)`` is the set of labels at or above x as a
bit mask, so the mask of a join is the AND of masks, joins aggregate with ``bit_and``, and
``leq`` is one bit test: all stay inside generated code and group by any key.  Lattices of more than
WORD labels take several words a mask, and do the same word by word.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.tables import running, written

BOTTOM, TOP = "bottom", "top"
#: Labels that one long holds as a mask.
WORD = 62


def _literal(value: list, kind: str) -> Column:
    """A large literal as one expression; built value by value it would take the planner seconds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class LatticeError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Lattice:
    """A finite lattice completed from declared chains, e.g. [["public", "client"], ["public", "ops"]].

    A compartment is a set of labels connected by chains.  One without a greatest label that lacks a
    join gets ``top(m)``, m its first minimal label.  Without a least label overall there is a
    ``bottom``; several compartments get a ``top`` that no data may carry.
    """

    chains: list[list[str]]
    strict: bool = False
    labels: list[str] = field(init=False)
    above: dict[str, set[str]] = field(init=False)

    def __post_init__(self):
        names = list(dict.fromkeys(x for c in self.chains for x in c))
        if bad := {BOTTOM, TOP} & set(names):
            raise LatticeError("E0706", f"reserved names {sorted(bad)}")
        # up-sets as rows of a bit matrix, closed from the upper labels down
        number = {x: i for i, x in enumerate(names)}
        pairs = [(a, b) for c in self.chains for a, b in zip(c, c[1:])]
        over: dict[str, list[str]] = {x: [] for x in names}
        waits = dict.fromkeys(names, 0)
        under: dict[str, list[str]] = {x: [] for x in names}
        for a, b in dict.fromkeys(pairs):
            over[a].append(b)
            under[b].append(a)
            waits[a] += 1
        up, ready = {}, [x for x in names if not waits[x]]
        while ready:
            x = ready.pop()
            up[x] = 1 << number[x]
            for y in over[x]:
                up[x] |= up[y]
            for y in under[x]:
                waits[y] -= 1
                if not waits[y]:
                    ready.append(y)
        if len(up) < len(names):
            raise LatticeError("E0701", f"cycle at {next((a, b) for a, b in pairs if waits[a] and waits[b])}")
        part = {x: x for x in names}

        def head(x):
            while part[x] != x:
                part[x] = part[part[x]]
                x = part[x]
            return x

        for a, b in pairs:
            part[head(b)] = head(a)
        groups: dict[str, list[str]] = {}
        for x in names:
            groups.setdefault(head(x), []).append(x)
        self.compartment = {x: i for i, members in enumerate(groups.values()) for x in members}
        self.compartments = len(groups)
        for i, members in enumerate(list(groups.values())):
            lone = [x for x in members if up[x] == 1 << number[x]]
            known = {up[x] for x in members}
            if len(lone) > 1 and any(up[a] & up[b] not in known for a, b in combinations(members, 2)):
                name = f"top({min(x for x in members if not under[x])})"
                number[name], self.compartment[name] = len(number), i
                up[name] = 1 << number[name]
                for x in members:
                    up[x] |= up[name]
        if not any(m.bit_count() == len(up) for m in up.values()):
            number[BOTTOM] = len(number)
            up[BOTTOM] = sum(1 << k for k in number.values())
        self.forbidden_top = self.compartments > 1
        if self.forbidden_top:
            number[TOP] = len(number)
            up = {x: m | 1 << number[TOP] for x, m in up.items()} | {TOP: 1 << number[TOP]}
        self.labels = list(number)
        self.up = {x: up[x] for x in self.labels}
        self.above = {x: {self.labels[k] for k in range(len(self.labels)) if m >> k & 1} for x, m in self.up.items()}
        self.bit = {x: 1 << i for i, x in enumerate(self.labels)}
        self.down = dict.fromkeys(self.labels, 0)
        for x in self.labels:
            for y in self.above[x]:
                self.down[y] |= self.bit[x]
        self._by_up, self._by_down = {m: x for x, m in self.up.items()}, {m: x for x, m in self.down.items()}
        self.bottom = next(x for x in self.labels if len(self.above[x]) == len(self.labels))
        self.top = next((x for x in self.labels if self.down[x].bit_count() == len(self.labels)), self.bottom)
        for a, b in combinations(self.labels, 2):
            if self.up[a] & self.up[b] not in self._by_up:  # the up-set of a join is what both up-sets share
                raise LatticeError("E0703", f"'{a}' and '{b}' have no least upper bound; declare a label above both and below their upper bounds")
        #: More labels than a long has bits take several words a mask.
        self.wide = len(self.labels) > WORD

    def leq(self, a: str, b: str) -> bool:
        return b in self.above[a]

    def join(self, *names: str) -> str:
        mask = self.up[self.bottom]
        for x in names:
            mask &= self.up[x]
        return self._by_up[mask]

    def meet(self, *names: str) -> str:
        mask = self.down[self.top]
        for x in names:
            mask &= self.down[x]
        return self._by_down.get(mask, self.bottom)

    def interval(self, lo: str, hi: str) -> list[str]:
        return [x for x in self.labels if self.leq(lo, x) and self.leq(x, hi)]

    def maximal(self, names) -> list[str]:
        return [x for x in names if not any(x != y and self.leq(x, y) for y in names)]

    def order(self) -> list[str]:
        """Labels, lower ones first."""
        return sorted(self.labels, key=lambda x: (-self.up[x].bit_count(), x))

    def covers(self) -> list[tuple[str, str]]:
        """The pairs (a, b) with a directly below b: the rules along which data may flow."""
        return [(a, b) for a in self.labels for b in self.labels if a != b and self.leq(a, b) and not any(x not in (a, b) and self.leq(a, x) and self.leq(x, b) for x in self.labels)]

    # --- as columns
    def as_map(self, table: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def _place(self, label: Column) -> Column:
        """The place of a label in ``order``: its bucket by CRC-32 is looked up in a literal array, then the few names in there."""
        buckets: list[list] = [[] for _ in range(2 * len(self.labels))]
        for k, x in enumerate(self.order()):
            buckets[zlib.crc32(x.encode()) % len(buckets)].append({"x": x, "k": k})
        table = _literal(buckets, "array<array<struct<x: string, k: int>>>")
        held = F.get(table, (F.crc32(label.cast("binary")) % len(buckets)).cast("int"))
        return F.get(F.filter(held, lambda e: e["x"] == label), F.lit(0))["k"]

    def _words(self, label: Column, of: dict, falling: bool = False) -> list[Column]:
        """Masks of a label as columns of WORD bits each; one for lattices that a long holds.

        In wide lattices bits stand in ``order`` (or against it, if ``falling``), so that the least bit of a join, or of a meet, is the label itself.
        """
        if not self.wide:
            return [F.element_at(self.as_map(of), label)]
        order = self.order()
        n = len(order)
        bit = {self.bit[x].bit_length() - 1: n - 1 - k if falling else k for k, x in enumerate(order)}
        masks = [sum(1 << bit[b] for b in range(n) if of[x] >> b & 1) for x in order]
        at = self._place(label)
        return [F.get(_literal([m >> lo & (1 << WORD) - 1 for m in masks], "array<bigint>"), at) for lo in range(0, n, WORD)]

    def _named(self, words: list[Column], of: dict, otherwise: str, falling: bool = False) -> Column:
        """The label of masks; a mask of no single label stands for ``otherwise``."""
        if not self.wide:
            return F.coalesce(F.element_at(self.as_map({m: x for x, m in of.items()}), words[0]), F.lit(otherwise))
        least = [F.when(w != 0, F.bit_count(w.bitwiseAND(-w) - 1) + k * WORD) for k, w in enumerate(words)]
        order = self.order()[::-1] if falling else self.order()
        return F.coalesce(F.get(_literal(order, "array<string>"), F.coalesce(*least).cast("int")), F.lit(otherwise))

    def up_words(self, label: Column) -> list[Column]:
        return self._words(label, self.up)

    def from_up_words(self, words: list[Column]) -> Column:
        return self._named(words, self.up, self.top)

    def up_mask(self, label: Column) -> Column:
        if self.wide:
            raise LatticeError("E0799", f"more than {WORD} labels take several words: use up_words")
        return self.up_words(label)[0]

    def col_leq(self, a: Column, b: Column) -> Column:
        met = [u.bitwiseAND(x) != 0 for u, x in zip(self.up_words(a), self._words(b, self.bit))]
        return reduce(Column.__or__, met)

    def col_join(self, *labels: Column) -> Column:
        return self.from_up_words([reduce(Column.bitwiseAND, w) for w in zip(*map(self.up_words, labels))])

    def col_meet(self, *labels: Column) -> Column:
        return self._named([reduce(Column.bitwiseAND, w) for w in zip(*[self._words(x, self.down, True) for x in labels])], self.down, self.bottom, True)

    def join_agg(self, label: Column) -> Column:
        return self.from_up_words([F.bit_and(w) for w in self.up_words(label)])

    def meet_agg(self, label: Column) -> Column:
        return self._named([F.bit_and(w) for w in self._words(label, self.down, True)], self.down, self.bottom, True)


def assign(df: DataFrame, labeller: Column, fallback: Column | None = None, name: str = "_label") -> DataFrame:
    """``df`` with its label; where the labeller fails (null) the input label, or ``fallback``, stays."""
    keep = fallback if fallback is not None else (F.col(name) if name in df.columns else F.lit(None).cast("string"))
    return df.withColumn(name, F.coalesce(labeller, keep))


def check(df: DataFrame, lattice: Lattice, ceiling: Column, enforce: bool = True, name: str = "_label") -> DataFrame:
    """Rows whose label may flow to ``ceiling``; in audit mode all rows with _violation."""
    ok = F.coalesce(lattice.col_leq(F.col(name), ceiling), F.lit(False))
    return df.where(ok) if enforce else df.withColumn("_violation", ~ok)


def emitted(df: DataFrame, lattice: Lattice, name: str = "_label") -> DataFrame:
    """Rows that may be emitted: never the forbidden top, nor the bottom in strict mode."""
    out = df.where(F.col(name) != lattice.top) if lattice.forbidden_top else df
    return out.where(F.col(name) != lattice.bottom) if lattice.strict else out


def within_range(df: DataFrame, lattice: Lattice, lo: str, hi: str, name: str = "_label") -> DataFrame:
    """``df`` with the labels that a stage reports bound to lo..hi: a missing one counts as ``hi``, and so does one outside, with _out_of_range."""
    label = F.coalesce(F.col(name), F.lit(hi))
    inside = label.isin(lattice.interval(lo, hi))
    return df.withColumn("_out_of_range", ~inside).withColumn(name, F.when(inside, label).otherwise(hi))


def sink_check(df: DataFrame, lattice: Lattice, sinks: list[str], names: tuple[str, ...] = ("_label",)) -> DataFrame:
    """``df`` with _violation: the join of its labels may not flow to the meet of the sinks' labels.  Rows without any label pass."""
    words = [[F.coalesce(w, F.lit(-1).cast("long")) for w in lattice.up_words(F.col(n))] for n in names]
    joined = [reduce(Column.bitwiseAND, w) for w in zip(*words)]
    sink = lattice._words(F.lit(lattice.meet(*sinks)), lattice.bit)
    return df.withColumn("_violation", ~reduce(Column.__or__, [w.bitwiseAND(x) != 0 for w, x in zip(joined, sink)]))


RULE = r"^\s*(\S+)\s+(->|-/>|<-|</-)\s+(\S+)\s*$"
ANY = "*"


def flow_rules(df: DataFrame, rule: str, order: str) -> DataFrame:
    """(domain, source, sink, allowed): the edges that a table of rules leaves, one rule a row.

    ``a -> b`` and ``a -/> b`` allow and forbid a flow of the write domain, ``b <- a`` and ``b </- a`` of the read domain; ``*`` stands for every
    label that the domain's rules name.  Of all rules for an edge, those with ``*`` too, the last by ``order`` holds.  Texts that are no
    rules, and nulls, raise an error when the edges are computed.
    """
    part = lambda k: F.regexp_extract(rule, RULE, k)
    fine = F.coalesce(F.col(rule).rlike(RULE), F.lit(False))
    arrow = F.when(fine, part(2)).otherwise(F.raise_error(F.concat(F.lit("E0710: not a rule: "), F.coalesce(rule, F.lit("null")))))
    read = arrow.startswith("<")
    r = df.select(F.when(read, "read").otherwise("write").alias("domain"), F.when(read, part(3)).otherwise(part(1)).alias("source"), F.when(read, part(1)).otherwise(part(3)).alias("sink"), (~arrow.contains("/")).alias("allowed"), F.col(order).alias("at"))
    names = r.select("domain", F.explode(F.array("source", "sink")).alias("x")).where(F.col("x") != ANY).distinct()
    for end in ("source", "sink"):  # a rule for any label is one for each; the names are those that the result has anyway
        each = r.where(F.col(end) == ANY).join(names, "domain").withColumn(end, F.col("x")).select(*r.columns)
        r = r.where(F.col(end) != ANY).union(each)
    return r.groupBy("domain", "source", "sink").agg(F.max_by("allowed", "at").alias("allowed"))


def flow_distances(edges: DataFrame) -> DataFrame:
    """(domain, source, target, distance, may_flow) of edges (domain, source, sink, allowed): the fewest allowed flows between labels.

    Pairs that no chain connects are missing; a label reaches itself in 0.  may_flow is false where the pair's own edge is forbidden, though a
    chain leads there.  Each round joins what the last one has found new with the edges, and ends when nothing is new: so many
    rounds as the longest distance, none of which sees a pair twice.
    """
    edges = written(edges)
    steps = edges.where("allowed and source <> sink").select("domain", F.col("source").alias("target"), F.col("sink").alias("next"))
    labels = edges.select("domain", F.explode(F.array("source", "sink")).alias("source")).distinct()
    new = written(labels.select("domain", "source", F.col("source").alias("target"), F.lit(0).cast("long").alias("distance")))
    found, d = new, 0
    while not new.isEmpty():
        d += 1
        met = new.join(steps, ["domain", "target"]).select("domain", "source", F.col("next").alias("target")).distinct()
        new = written(met.join(found, ["domain", "source", "target"], "left_anti").withColumn("distance", F.lit(d).cast("long")))
        found = found.unionByName(new)
    barred = edges.where("not allowed").select("domain", "source", F.col("sink").alias("target"), F.lit(True).alias("barred"))
    return found.join(barred, ["domain", "source", "target"], "left").select("domain", "source", "target", "distance", F.col("barred").isNull().alias("may_flow"))


def taint(df: DataFrame, lattice: Lattice, instance: str, order: str, name: str = "_label") -> DataFrame:
    """``df`` with _taint: the join of all labels its instance has received up to the row."""
    words = {f"_taint_{k}": ("bit_and", w) for k, w in enumerate(lattice.up_words(F.col(name)))}
    out = running(df, order, (instance,), **words)
    return out.withColumn("_taint", lattice.from_up_words([F.col(w) for w in words])).drop(*words)


def first_compartment(df: DataFrame, lattice: Lattice, instance: str, order: str, name: str = "_label") -> DataFrame:
    """Rows in the compartment of their instance's first labelled row; labels of none always pass."""
    comp = F.element_at(lattice.as_map(lattice.compartment), F.col(name))
    first = df.where(comp.isNotNull()).groupBy(instance).agg(F.min_by(comp, order).alias("_first"))
    out = df.join(first, instance, "left")
    return out.where(comp.isNull() | F.col("_first").isNull() | (comp == F.col("_first"))).drop("_first")


def propagate(df: DataFrame, lattice: Lattice, name: str, value: Column, *operands: str) -> DataFrame:
    """A derived column with its label column: the join of its operands' labels (``x`` has ``x_label``)."""
    return df.withColumn(name, value).withColumn(f"{name}_label", lattice.col_join(*[F.col(f"{x}_label") for x in operands]))


def reports(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """(kind, node, detail) rows of several negated filters: (rows, kind, node) each, detail from column ``detail``."""
    out = None
    for df, kind, node in parts:
        rows = df.select(F.lit(kind).alias("kind"), F.lit(node).alias("node"), F.col("detail").cast("string").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out
