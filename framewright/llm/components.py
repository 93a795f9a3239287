"""Distributed union-find: connected components of an edge table by alternating large and small stars.

Both steps are a grouped minimum and a join, so no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, with v replaced by its own least neighbour: a node without a smaller one stays."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges of each node, and of its smaller neighbours, to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    linked = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
    both = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
    return both.where("u <> v").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """One round of both steps on edges (u, v), v < u: others like them, with the same components."""
    return _small_star(_large_star(edges))


def _stars_only(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) are final: each u has one v, and no v is a u."""
    down = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = down.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its least node.

    Nulls and self-loops are ignored and repeated edges count once; an empty table gives an empty table.
    Each round is written to the shared folder, so the lineage stays short and lost executors cost one round.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = stored(_small_star(edges), "star")
    while not _stars_only(now):
        after = stored(contracted(now), "star")
        drop(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
