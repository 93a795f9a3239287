"""Connected components of an edge table, without a group in one task: alternating stars of grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the least node that it is linked with, through others as well.

    Nodes are of any type that has an order.  Self-loops, repeated edges and nulls add nothing; no edges give no rows.
    Every round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = written(ordered, "stars"), None
    while True:
        # a sum of hashes, and not the count alone, tells whether a round has changed anything
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == state or not mark[0]:
            break
        state = mark
        above = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("root"))
        up = now.join(above, "v", "left").select("u", F.coalesce("root", "v").alias("v"))  # to the least neighbour of one's neighbour
        star = up.join(up.groupBy("u").agg(F.min("v").alias("root")), "u")  # all that one is linked with to the least of these
        now = written(star.select("u", F.col("root").alias("v")).unionByName(star.select(F.col("v").alias("u"), F.col("root").alias("v"))).where("u <> v").distinct(), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
