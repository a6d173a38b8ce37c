"""Lattices against a naive model on generated orders, and label columns against the lattice."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from labelflow.operators import labels as lb
from labelflow.tables import running


def reachable(chains):
    """x -> all y with x <= y, by repeated steps along the declared pairs."""
    pairs = {(a, b) for c in chains for a, b in zip(c, c[1:])}
    out = {x: {x} for c in chains for x in c}
    while True:
        new = {x: s | {b for a, b in pairs if a in s} for x, s in out.items()}
        if new == out:
            return out
        out = new


def grid(n, m):
    """The chains of a product of two orders, which is a lattice: rows and columns of g<i><j>."""
    return [[f"g{i}{j}" for j in range(m)] for i in range(n)] + [[f"g{i}{j}" for i in range(n)] for j in range(m)]


@pytest.mark.parametrize("n,m", [(1, 4), (2, 3), (3, 3), (4, 5)])
def test_grids_join_and_meet_by_coordinates(n, m):
    x = lb.Lattice(grid(n, m))
    assert (x.bottom, x.top, x.forbidden_top, x.compartments) == ("g00", f"g{n - 1}{m - 1}", False, 1)
    for (i, j), (k, l) in product(product(range(n), range(m)), repeat=2):
        assert x.join(f"g{i}{j}", f"g{k}{l}") == f"g{max(i, k)}{max(j, l)}" and x.meet(f"g{i}{j}", f"g{k}{l}") == f"g{min(i, k)}{min(j, l)}"
        assert x.leq(f"g{i}{j}", f"g{k}{l}") == (i <= k and j <= l)


def test_generated_trees_are_completed():
    rng = random.Random(21)
    for _ in range(40):
        parts = [[f"p{p}n0"] for p in range(rng.randint(1, 3))]
        chains = []
        for p, nodes in enumerate(parts):
            for k in range(1, rng.randint(2, 6)):
                chains.append([rng.choice(nodes), f"p{p}n{k}"])
                nodes.append(f"p{p}n{k}")
        rng.shuffle(chains)
        x, order = lb.Lattice(chains), reachable(chains)
        made = set(x.labels) - set(order)
        assert all(x.leq(a, b) == (b in order[a]) for a, b in product(order, order))
        assert x.compartments == len(parts) and x.forbidden_top == (len(parts) > 1) and (lb.BOTTOM in made) == (len(parts) > 1)
        for p, nodes in enumerate(parts):
            leaves = [a for a in nodes if order[a] == {a}]
            assert (f"top(p{p}n0)" in made) == (len(leaves) > 1)
        for a, b in product(x.labels, x.labels):
            j, m = x.join(a, b), x.meet(a, b)
            assert x.leq(a, j) and x.leq(b, j) and x.leq(m, a) and x.leq(m, b)
            assert all(x.leq(j, u) for u in x.labels if x.leq(a, u) and x.leq(b, u)) and all(x.leq(u, m) for u in x.labels if x.leq(u, a) and x.leq(u, b))
        assert {(a, b) for a, b in x.covers()} <= {(a, b) for a, b in product(x.labels, x.labels) if x.leq(a, b)}


@pytest.mark.parametrize("chains,code", [([["k", "l", "m"], ["m", "k"]], "E0701"), ([["low1", "up1"], ["low1", "up2"], ["low2", "up2"], ["low2", "up1"]], "E0703"), ([["k", lb.TOP]], "E0706"), ([[lb.BOTTOM, "k"]], "E0706")])
def test_errors(chains, code):
    with pytest.raises(lb.LatticeError) as e:
        lb.Lattice(chains)
    assert e.value.code == code


def test_columns_agree_with_the_lattice(spark):
    for x in (lb.Lattice(grid(2, 3)), lb.Lattice([["u", "v"], ["u", "w"], ["r", "s"]])):
        rows = spark.createDataFrame([(a, b) for a in x.labels for b in x.labels], "a string, b string")
        a, b = F.col("a"), F.col("b")
        got = rows.select("a", "b", x.col_leq(a, b).alias("leq"), x.col_join(a, b).alias("join"), x.col_meet(a, b).alias("meet")).collect()
        for r in got:
            assert (r["leq"], r["join"], r["meet"]) == (x.leq(r["a"], r["b"]), x.join(r["a"], r["b"]), x.meet(r["a"], r["b"]))


def test_flow_rules_over_tables(spark):
    def table_of(*rules):
        return lb.flow_rules(spark.createDataFrame(list(enumerate(rules)), "at long, rule string"), "rule", "at")

    got = {(r["domain"], r["source"], r["target"]): (r["distance"], r["may_flow"]) for r in lb.flow_distances(table_of("a -> b", "b -/> c", "b -> c", " c ->  a", "a -/> c", "x <- y", "y <- z", "x </- z", "p -> q", "p -/> *", "p -> r")).collect()}
    write = {(s, t): v[0] for (d, s, t), v in got.items() if d == "write"}
    cycle = {(x, y): (ord(y) - ord(x)) % 3 for x in "abc" for y in "abc"}
    assert write == cycle | {("p", "p"): 0, ("q", "q"): 0, ("r", "r"): 0, ("p", "r"): 1}
    assert got["write", "a", "c"] == (2, False) and got["write", "a", "b"] == (1, True)
    assert {(s, t): v for (d, s, t), v in got.items() if d == "read"} == {("x", "x"): (0, True), ("y", "y"): (0, True), ("z", "z"): (0, True), ("y", "x"): (1, True), ("z", "y"): (1, True), ("z", "x"): (2, False)}
    rng = random.Random(4)
    rules = [f"n{rng.randrange(12)} -> n{rng.randrange(12)}" for _ in range(18)] + ["* -> n3"]
    edges = {tuple(r.split(" -> ")) for r in rules}
    names = sorted({x for e in edges for x in e} - {"*"})
    edges = {(a, b) for a, b in edges if a != "*"} | {(x, "n3") for x in names}
    want = {(x, x): 0 for x in names}
    for d in range(1, 13):
        want |= {(x, b): d for (x, y), k in list(want.items()) for a, b in edges if k == d - 1 and a == y and (x, b) not in want}
    assert {(r["source"], r["target"]): r["distance"] for r in lb.flow_distances(table_of(*rules)).collect()} == want
    assert lb.flow_distances(table_of("a -> b").where("false")).collect() == []
    with pytest.raises(Exception, match="E0710"):
        table_of("a => b").collect()


def test_ranges_and_sinks(spark):
    x = lb.Lattice(grid(2, 2))
    d = spark.createDataFrame([("g00",), ("g01",), (None,), ("g11",)], "_label string")
    assert [(r["_label"], r["_out_of_range"]) for r in lb.within_range(d, x, "g01", "g11").collect()] == [("g11", True), ("g01", False), ("g11", False), ("g11", False)]
    assert [r["_violation"] for r in lb.sink_check(d, x, ["g01", "g11"]).collect()] == [False, False, False, True]


def test_running_over_slices_equals_one_window(spark):
    d = spark.range(500).select(F.col("id").alias("o"), (F.col("id") * 37 % 101).alias("v"), (F.col("id") % 3).alias("k"))
    got = running(d, "o", ("k",), width=16, s=("sum", F.col("v")), m=("max", F.col("v")), n=("count", F.lit(1))).collect()
    state = {}
    for r in sorted(got, key=lambda r: r["o"]):
        s, m, n = state.get(r["k"], (0, 0, 0))
        state[r["k"]] = (s + r["v"], max(m, r["v"]), n + 1)
        assert (r["s"], r["m"], r["n"]) == state[r["k"]]


def test_wide_lattices_as_columns(spark):
    rng = random.Random(8)
    chains = [[f"t{rng.randrange(max(1, k // 3), k) if k > 1 else 0}", f"t{k}"] for k in range(1, 90)]  # a tree with a top over its leaves
    for x in (lb.Lattice(chains), lb.Lattice(grid(9, 9)), lb.Lattice([*grid(8, 8), ["other", "side"]])):
        assert x.wide and (lb.TOP in x.labels) == (x.compartments > 1)
        pairs = [(rng.choice(x.labels), rng.choice(x.labels)) for _ in range(150)] + [(a, a) for a in x.labels[:5]]
        df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
        a, b = F.col("a"), F.col("b")
        for r in df.select("a", "b", x.col_join(a, b).alias("j"), x.col_meet(a, b).alias("m"), x.col_leq(a, b).alias("leq")).collect():
            assert (r["j"], r["m"], r["leq"]) == (x.join(r["a"], r["b"]), x.meet(r["a"], r["b"]), x.leq(r["a"], r["b"]))
        row = df.agg(x.join_agg(a).alias("j"), x.meet_agg(a).alias("m")).first()
        assert row["j"] == x.join(*[p for p, _ in pairs]) and row["m"] == x.meet(*[p for p, _ in pairs])
        assert df.select(x.col_leq(F.lit("nobody"), b).alias("v")).first()["v"] is None
        got = {r["k"]: r["_taint"] for r in lb.taint(df.withColumn("one", F.lit(1)), x, "one", "k", "a").collect()}
        assert got == {k: x.join(*[p for p, _ in pairs[: k + 1]]) for k in got}


def test_large_lattices_are_closed_fast():
    import time

    began = time.time()
    x = lb.Lattice([[f"{i}.{j}" for j in range(25)] for i in range(20)] + [[f"{i}.{j}" for i in range(20)] for j in range(25)])
    assert time.time() - began < 5 and len(x.labels) == 500 and x.join("17.0", "0.24") == "17.24" and x.meet("17.0", "0.24") == "0.0"
    with pytest.raises(lb.LatticeError, match="E0701"):
        lb.Lattice([["a", "b", "c"], ["c", "d", "a"]])
    with pytest.raises(lb.LatticeError, match="E0703"):
        lb.Lattice([["a", "c", "z"], ["a", "d", "z"], ["b", "c"], ["b", "d"]])
