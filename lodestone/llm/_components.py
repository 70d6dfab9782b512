"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _hangs(edges: DataFrame) -> bool:
    """Whether every node hangs on one root already: no node has two, and no root hangs on another."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("below")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("below")),
            )
        ).alias("x")
    )
    found = ends.groupBy("x.node").agg(F.sum("x.below").alias("below"), F.min("x.below").alias("least"))
    return found.where("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of the edges, root being the smallest node of its component; staged.

    Each step is an aggregation and an equi-join, staged in the shared folder; after about log(diameter) rounds every
    node hangs on its root, and edges that are stars to begin with need no round. No component is gathered anywhere, and
    AQE may split the join of a large one.
    """
    scratch = _shared.Scratch(edges.sparkSession)
    one_way = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = scratch.stage(one_way, "star", short=True)
    while not _hangs(now):
        # large star: each node's larger neighbours are hung on its smallest neighbour or itself
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself are hung on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        now = scratch.stage(small.where("u <> v").distinct(), "star", short=True)
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = _shared.staged(roots.union(ends), "roots", short=True)
    scratch.clear()
    return found


def joined(roots: DataFrame, edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) when further edges join the components that roots has; only the edges between roots are worked on."""
    lifted = edges.select(u, v)
    for end in (u, v):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        lifted = lifted.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    tops = components(lifted, u, v)
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    # roots of old components are among the old nodes; nodes that had no component come with the new ones
    fresh = tops.join(roots.select("node"), "node", "left_anti")
    return _shared.staged(moved.union(fresh), "roots", short=True)
