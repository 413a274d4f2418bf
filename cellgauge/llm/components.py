"""Connected components by alternating large-star and small-star, each round a written table.

Links that come later are put on the components known before, so that only these are joined anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _settled(step: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars: every u has one v, and no v is a u."""
    ends = step.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.union(step.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return ends.where("up > 1 OR (up = 1 AND root = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component: every node of edges(a, b) but the smallest of each component, with that smallest."""
    step = scratch.save(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0"
    )
    i = 0
    while not _settled(step):
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        i += 1
        step = scratch.save(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    return step.select(F.col("u").alias("node"), F.col("v").alias("component"))


def extended_components(known: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component of the edges(a, b) and those that made ``known`` (node, component).

    Each end is replaced by its component.  What is left is a graph of components and of nodes
    without one, none of which is a node of ``known``; its components are put together with these.
    """
    a = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = scratch.save(between.where("a <> b").distinct(), f"{name}between")
    if between.isEmpty():
        return known
    joined = connected_components(between, scratch, name)
    moved = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    moved = moved.select("node", F.coalesce("top", "component").alias("component"))
    return scratch.save(moved.unionByName(joined), f"{name}all")
