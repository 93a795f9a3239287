"""The kinds of change as transforms of DOM node tables, their truth, and overlays on images."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import round_half_up
from ..sources.png import encode_png

#: Id, kind, magnitude, and what each of the mutations does to a node.
MUTATIONS = [
    ("spatial-shift-small", "spatial-shift", "small", "shift", "6"),
    ("spatial-shift-large", "spatial-shift", "large", "shift", "28"),
    ("color-change-small", "color-change", "small", "background", "#3b6fe0"),
    ("color-change-large", "color-change", "large", "background", "#dc2626"),
    ("size-change-small", "size-change", "small", "scale", "1.1"),
    ("size-change-large", "size-change", "large", "scale", "1.35"),
    ("text-change-similar", "text-change", "small", "suffix", " (new)"),
    ("text-change-different", "text-change", "large", "text", "An entirely different and rather longer text"),
    ("element-add", "element-add", "large", "add", ""),
    ("element-remove", "element-remove", "large", "remove", ""),
    ("style-change-weight", "style-change", "small", "weight", "400"),
    ("style-change-radius", "style-change", "large", "radius", "0px"),
    ("none", "none", "small", "none", ""),
]


def mutate(nodes: DataFrame) -> DataFrame:
    """Later snapshots of nodes that carry ``effect`` and ``argument`` where they are a mutation's target.

    Added elements are copies of the target beside it, at the end; removed ones are gone; sizes round half up.
    """
    e, a = F.coalesce("effect", F.lit("none")), F.col("argument")

    def where(effect: str, value: Column, column: str) -> Column:
        return F.when(e == effect, value).otherwise(F.col(column)).alias(column)

    scaled = {c: where("scale", round_half_up(F.col(c) * F.when(e == "scale", a).cast("double")), c) for c in ("w", "h")}
    changed = {
        "x": where("shift", F.col("x") + F.when(e == "shift", a).cast("double"), "x"),
        **scaled,
        "text": F.when(e == "suffix", F.concat("text", "argument")).when(e == "text", a).otherwise(F.col("text")).alias("text"),
        "background_color": where("background", a, "background_color"),
        "font_weight": where("weight", a, "font_weight"),
        "border_radius": where("radius", a, "border_radius"),
    }
    kept = nodes.where(e != "remove").select(*(changed.get(c, F.col(c)) for c in nodes.columns))
    added = nodes.where(e == "add").withColumn("path", F.concat("path", F.lit("+"))).withColumn("ord", F.col("ord") + (1 << 20))
    return kept.unionByName(added).drop("effect", "argument")


def truth_rect(kind: Column, before: Column, last_child: Column, union: Column) -> Column:
    """Of a removal the earlier rectangle, of an addition the new last child's, of no change null, else the union box."""
    return F.when(kind == "none", None).when(kind == "element-remove", before).when(kind == "element-add", last_child).otherwise(union)


def _colour(value: str | None) -> tuple[int, int, int, int]:
    """An opaque colour: of a hexadecimal value its own, of another text one that depends on it, of null none."""
    if value is None:
        return (0, 0, 0, 0)
    if re.fullmatch("#[0-9a-fA-F]{6}", value):
        return (*bytes.fromhex(value[1:]), 255)
    return (*zlib.crc32(value.encode()).to_bytes(4, "big")[:3], 255)


def painted(nodes: list[tuple], width: int, height: int) -> np.ndarray:
    """A white page with the rectangles (x, y, w, h, background colour) of nodes, one over another."""
    page = np.full((height, width, 4), 255, np.uint8)
    for x, y, w, h, background in nodes:
        colour = _colour(background)
        if colour[3]:
            page[max(0, round(y)) : max(0, round(y + h)), max(0, round(x)) : max(0, round(x + w))] = colour
    return page


def render_pairs(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """(pair_id, before, after, truth) of nodes that carry ``effect`` and ``argument``: PNG images of both snapshots, without a browser.

    Rectangles are painted in the order of ``ord``, so images show place, size and background, not text.  The truth
    is the box around the changed nodes after the change, of a removal before it; null where nothing changes.
    A pair's nodes are one page, whose image one task paints.
    """
    target = F.coalesce("effect", F.lit("none")) != "none"
    later = mutate(nodes)
    shape = [F.col(c).cast("double").alias(c) for c in "xywh"]
    rects = {k: df.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", *shape, "background_color"))).alias(k)) for k, df in (("b", nodes), ("a", later))}
    gone, added = nodes.where(F.col("effect") == "remove"), later.where(F.col("path").endswith("+"))
    moved = later.join(nodes.where(target & (F.col("effect") != "add")).select("pair_id", "path"), ["pair_id", "path"], "left_semi")
    box = F.struct(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
    truth = gone.drop("effect", "argument").unionByName(added).unionByName(moved).groupBy("pair_id").agg(box.alias("truth"))
    both = rects["b"].join(rects["a"], "pair_id", "full").join(truth, "pair_id", "left")

    def run(frames):
        for frame in frames:
            for side, name in (("b", "before"), ("a", "after")):
                frame[name] = [encode_png(painted([(r["x"], r["y"], r["w"], r["h"], r["background_color"]) for r in (rows if rows is not None else ())], width, height)) for rows in frame[side]]
            yield frame[["pair_id", "before", "after"]]

    kind = both.schema["pair_id"].dataType.simpleString()
    images = both.select("pair_id", "b", "a").mapInPandas(run, f"pair_id {kind}, before binary, after binary")
    return images.join(truth, "pair_id", "left")


def draw_box(rgba: np.ndarray, x: int, y: int, w: int, h: int, colour: tuple[int, int, int], thickness: int = 2) -> np.ndarray:
    """The image with the outline of a rectangle, cut off at its edges."""
    out = rgba.copy()
    tall, wide = out.shape[:2]
    yy, xx = np.mgrid[max(0, y) : max(0, min(tall, y + h)), max(0, x) : max(0, min(wide, x + w))]
    edge = (yy - y < thickness) | (y + h - 1 - yy < thickness) | (xx - x < thickness) | (x + w - 1 - xx < thickness)
    out[yy[edge], xx[edge]] = (*colour, 255)
    return out
