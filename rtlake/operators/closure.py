"""Closures over edge tables by frontier expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the session's shared checkpoint folder, without its lineage."""
    import re
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rtlake-"))
    return df.checkpoint(eager=True)


def reach(edges: DataFrame, start: DataFrame, limit: int = 1_000) -> DataFrame:
    """(root, node, depth) from (src, dst) edges and (root) starts: every node that a root reaches, at its least depth.

    Each round extends only what the last one found, and drops what is known, so cycles end. The lineage is cut every
    round. ``limit`` guards against endless rounds and raises rather than returning a part.
    """
    edges = edges.select("src", "dst").distinct()
    known = frontier = cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, limit + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)  # a union of cut tables; cut itself now and then, so that its plan stays short
        known = cut(known) if depth % 16 == 0 else known
    raise RuntimeError(f"no fixpoint after {limit} rounds")


def ancestors(parents: DataFrame, start: DataFrame, limit: int = 64) -> DataFrame:
    """(root, node, depth) up a table (node, parent) of at most one parent a node: the inheritance chain, nearest first, cycles cut."""
    return reach(parents.select(F.col("node").alias("src"), F.col("parent").alias("dst")).filter("dst IS NOT NULL"), start, limit)


def lineage(parents: DataFrame, limit: int = 16) -> DataFrame:
    """(node, ancestor, depth) up a table (node, parent) of at most one parent a node: every node of it itself, then nearest first.

    By doubling: what is known up to a distance is joined with itself, so a chain takes as many rounds as its length has bits.
    Of a node with several parents the least counts; a cycle ends where it closes.
    """
    up = parents.filter("parent IS NOT NULL AND parent <> node").groupBy("node").agg(F.min("parent").alias("parent"))
    every = parents.select("node").union(parents.select("parent")).filter("node IS NOT NULL").distinct()
    known = cut(every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).union(up.select("node", "parent", F.lit(1))))
    n = known.count()
    for _ in range(limit):
        further = known.filter("depth > 0").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        step = known.filter("depth > 0").join(further, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known, before = cut(known.union(step).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))), n
        n = known.count()
        if n == before:
            return known
    raise RuntimeError(f"no fixpoint after {limit} doublings")


def provided(exports: DataFrame, own: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, name) that each package provides: its own names, names it exports one by one, and all of those it exports whole.

    ``exports``: (package, source, item); item ``*`` re-exports everything the source provides, through any number of steps.
    """
    whole = exports.filter("item = '*'").select(F.col("package").alias("src"), F.col("source").alias("dst"))
    closure = reach(whole, packages.select(F.col("package").alias("root")))
    through = closure.join(own.select(F.col("package").alias("node"), "name"), "node").select(F.col("root").alias("package"), "name")
    single = exports.filter("item <> '*'").select(F.col("package").alias("node"), F.col("item").alias("name"))
    named = closure.join(single, "node").select(F.col("root").alias("package"), "name")
    return through.union(named).distinct()
