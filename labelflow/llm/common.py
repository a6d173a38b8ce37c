"""Shared pieces: written tables that cut lineage, joins on hot keys, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it is one of the HOT_PARTS most frequent and has more than HOT_LEAST rows.
HOT_PARTS, HOT_LEAST = 1000, 500
#: Tables of at most so many rows are joined as they are.
HOT_TABLE = 10_000
#: Edges (8 MB) that a task contracts by itself before components are grown across tasks.
TASK_EDGES = 500_000

#: After tables of more rows the driver's garbage is collected, since Spark deletes the shuffle files of finished steps only then.
LARGE = 100_000

#: With this set, Spark deletes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders made for local applications without the setting.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where the setting is missing, a local application (one machine, as in tests) gets a
    temporary folder; on a cluster, where none would be shared, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="labelflow-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


class Scratch:
    """Tables written once and read by later steps; they outlive executors.

    ``save`` writes a DataFrame as Parquet and returns it as read back, so
    a lost executor never makes earlier steps run again.  ``drop`` removes the
    tables that later steps no longer read; what is left (results that a caller may still
    read) goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/labelflow-{uuid.uuid4().hex}"
        self.n = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, **measures) -> DataFrame:
        """``df`` as read back; ``counts`` of the result has its rows and, by name, other aggregates taken as it was written."""
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # the written table is read from now on, its shuffles never again
        try:
            df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()]).write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if self.n == 1:
            root, fs = self._path(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.labelflow_path, out.counts = path, seen.get
        if out.counts["rows"] > LARGE:
            self.spark._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._path(t.labelflow_path)
            fs.delete(path, True)


def hot_keys(rows: DataFrame, key: str) -> list[tuple]:
    """(key, rows) of the hot keys of a written table: the HOT_PARTS most frequent ones with more than HOT_LEAST rows.

    Any other key with so many rows has less than one in HOT_PARTS of the table; the list may be literals.
    """
    if rows.counts["rows"] <= HOT_TABLE:
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_LEAST)
    return [tuple(r) for r in counts.orderBy(F.desc("_n"), key).limit(HOT_PARTS).collect()]


def lookup(rows: DataFrame, keys: list[str], table: DataFrame, how: str = "left", hot: list | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key, so that no key's rows meet in one task.

    ``rows`` is a written table, or ``hot`` its hot keys.  Rows with a hot value in the first key are joined
    by broadcasting the table's rows for those values, HOT_PARTS at most; all others are dealt out by key at any size.
    """
    hot = hot_keys(rows, keys[0]) if hot is None else hot
    if not hot:
        return rows.hint("merge").join(table, keys, how)
    is_hot = F.coalesce(F.col(keys[0]).isin([k for k, _ in hot]), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), keys, how).unionByName(rows.where(~is_hot).hint("merge").join(table, keys, how))


def _contract(batches):
    """A task's edges (x, y) -> (x, y): each node y of them once, with the smallest node x that it reaches over them."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    x, y = (np.concatenate(c) for c in zip(*parts))
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, root = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    for lo in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[lo : lo + 50_000]]), pa.array(nodes[lo : lo + 50_000])], ["x", "y"])


def _contracted(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` (x, y), ``rows`` of them, as a star for each component of each task; tasks have about TASK_EDGES edges."""
    return edges.coalesce(-(-rows // TASK_EDGES) or 1).mapInArrow(_contract, "x long, y long")


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): component is the smallest id reachable over the edges.

    Each task first contracts its own edges, TASK_EDGES or so, to stars.  Where there were more,
    distributed union-find by hooking and pointer jumping follows.  Each round hooks every
    component label to the smallest label it touches, shortens the parent
    chains until they are stars, and keeps only edges between different
    labels.  A round removes every label that touches a smaller one, so the
    edges shrink at least geometrically.  All steps are aggregations with
    partial sums and joins by ``lookup``, so a hub costs no single task.
    Nulls: edges with a null end are ignored.  Repeated edges and self loops
    change nothing.  Nodes without an edge do not appear.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    if not hasattr(edges, "counts"):
        edges = e = scratch.save(e)
    rows = edges.counts["rows"]
    e = scratch.save(_contracted(e, rows))
    if rows <= TASK_EDGES:
        return _labels(e)
    e = scratch.save(e.where("x <> y").distinct())
    labels = scratch.save(e.select(F.col("x").alias("node")).union(e.select("y")).distinct().select("node", F.col("node").alias("component")))
    while e.counts["rows"]:
        parent = scratch.save(e.groupBy(F.col("y").alias("v")).agg(F.min("x").alias("p")))
        while True:
            hop = lookup(parent, ["p"], parent.select(F.col("v").alias("p"), F.col("p").alias("pp")))
            hop = hop.select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
            hop = scratch.save(hop, moved=F.count_if("moved"))
            scratch.drop(parent)
            parent = hop
            if not hop.counts["moved"]:
                break
        new_labels = lookup(labels, ["component"], parent.select(F.col("v").alias("component"), "p"))
        new_labels = scratch.save(new_labels.select("node", F.coalesce("p", "component").alias("component")))
        # y always has a parent; x has one unless it is a root
        moved_e = lookup(e, ["x"], parent.select(F.col("v").alias("x"), F.col("p").alias("px")))
        moved_e = lookup(moved_e, ["y"], parent.select(F.col("v").alias("y"), F.col("p").alias("py")), hot=hot_keys(e, "y"))
        moved_e = moved_e.select(F.coalesce("px", "x").alias("l"), F.coalesce("py", "y").alias("r")).where("l <> r")
        new_e = scratch.save(moved_e.select(F.least("l", "r").alias("x"), F.greatest("l", "r").alias("y")).distinct())
        scratch.drop(parent, labels, e)
        e, labels = new_e, new_labels
    scratch.drop(e)
    return labels


def _labels(stars: DataFrame) -> DataFrame:
    """The written table ``stars`` (x, y) as (node, component)."""
    out = stars.select(F.col("y").alias("node"), F.col("x").alias("component"))
    out.labelflow_path, out.counts = stars.labelflow_path, stars.counts
    return out


def extend_components(scratch: Scratch, comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``comp`` (node, component) after further ``links`` (src, dst), a written table; only labels are joined anew."""
    rows = comp.counts["rows"] + links.counts["rows"]
    if rows <= TASK_EDGES:
        both = comp.select(F.col("component").alias("x"), F.col("node").alias("y")).union(links.select("src", "dst"))
        out = _labels(scratch.save(_contracted(both, rows)))
        scratch.drop(comp)
        return out

    def label(rows: DataFrame, end: str) -> DataFrame:
        found = lookup(rows, [end], comp.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), hot=hot_keys(links, end))
        return found.withColumn(f"_{end}", F.coalesce(f"_{end}", end))

    new = connected_components(scratch, label(label(links, "src"), "dst").select("_src", "_dst"), "_src", "_dst")
    moved = lookup(comp, ["component"], new.select(F.col("node").alias("component"), F.col("component").alias("to")))
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    out = scratch.save(moved.union(new.join(comp.select("node"), "node", "left_anti").select("node", "component")))
    scratch.drop(new, comp)
    return out


def with_smallest(scratch: Scratch, classes: DataFrame, comp: DataFrame, id_col: str) -> DataFrame:
    """``classes`` (rep, ``id_col``, ...) with component_id: the smallest id among the classes of its component (node, component)."""
    linked = scratch.save(classes.select("rep", id_col).join(comp.select(F.col("node").alias("rep"), "component"), "rep"))
    best = linked.groupBy("component").agg(F.min(id_col).alias("component_id"))
    named = lookup(linked, ["component"], best).select("rep", "component_id")
    return classes.join(named, "rep", "left").withColumn("component_id", F.coalesce("component_id", id_col))
