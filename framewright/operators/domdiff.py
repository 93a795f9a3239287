"""Keyed difference of two DOM snapshots per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, moved

#: Fields that are compared, after the rectangle, in the order they are reported.
COMPARED = [("text", "text"), ("color", "color"), ("background_color", "backgroundColor"), ("font_weight", "fontWeight"), ("border_radius", "borderRadius")]
NODE = "array<struct<path:string,tag:string,id:string,className:string,text:string,rect:struct<x:double,y:double,w:double,h:double>,style:struct<color:string,backgroundColor:string,fontWeight:string,borderRadius:string>>>"
#: Nodes that only the later snapshot has come after all others.
AFTER_ONLY = 1 << 40
_CARRIED = ["id", "text", "x", "y", "w", "h", "color", "background_color", "font_weight", "border_radius"]


def parse_snapshot(df: DataFrame, column: str, key: str = "pair_id") -> DataFrame:
    """One row per node of a JSON snapshot, with its place as ``ord``."""
    nodes = df.select(key, F.posexplode(F.from_json(column, NODE)).alias("ord", "n"))
    style = [F.col(f"n.style.{c}").alias(n) for c, n in (("color", "color"), ("backgroundColor", "background_color"), ("fontWeight", "font_weight"), ("borderRadius", "border_radius"))]
    return nodes.select(key, F.col("ord").cast("bigint").alias("ord"), "n.path", "n.tag", "n.id", F.col("n.className").alias("class_name"), "n.text", "n.rect.*", *style)


def last_wins(nodes: DataFrame) -> DataFrame:
    """One row per (pair_id, path): the last node's values at the first node's place."""
    last = F.max_by(F.struct(*_CARRIED), "ord").alias("n")
    return nodes.groupBy("pair_id", "path").agg(last, F.min("ord").alias("ord")).select("pair_id", "path", "ord", "n.*")


def dom_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed nodes: pair_id, path, id, x, y, w, h of the later node (of the earlier where removed), changed_fields, ord.

    Both snapshots are dealt out once, by (pair_id, path), so no pair lies in one task; snapshots that both lie by pair_id
    already stay as they lie.  The last node of a path counts on either side, at the place of the first.
    """
    sides = [df.select("pair_id", "path", "ord", F.struct(*_CARRIED).alias("n"), F.lit(k).alias("later")) for k, df in enumerate((before, after))]
    place = {k: F.when(F.col("later") == i, F.col("ord")) for i, k in enumerate("ba")}
    nodes = sides[0].unionByName(sides[1]).groupBy("pair_id", "path")
    both = nodes.agg(*(F.max_by("n", place[k]).alias(k) for k in "ba"), *(F.min(place[k]).alias(f"{k}_ord") for k in "ba"))
    differs = [F.when(moved(Rect("b."), Rect("a.")), "rect"), *(F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), name) for c, name in COMPARED)]
    fields = F.when(F.col("b_ord").isNull(), F.array(F.lit("added"))).when(F.col("a_ord").isNull(), F.array(F.lit("removed"))).otherwise(F.array_compact(F.array(*differs)))
    kept = [F.when(F.col("a_ord").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("id", "x", "y", "w", "h")]
    out = both.select("pair_id", "path", *kept, fields.alias("changed_fields"), F.coalesce("b_ord", F.col("a_ord") + F.lit(AFTER_ONLY)).alias("ord"))
    return out.where(F.size("changed_fields") > 0)


def change_counts(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, dom_change_count, changed of every pair; without a DOM change a pair is unchanged."""
    counts = changes.groupBy("pair_id").agg(F.count("*").alias("n"))
    out = pairs.select("pair_id").join(counts, "pair_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("pair_id", F.col("n").alias("dom_change_count"), (F.col("n") > 0).alias("changed"))
