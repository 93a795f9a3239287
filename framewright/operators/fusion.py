"""Fusion of DOM changes and pixel regions into candidate regions per pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Fields, overlap
from ..sources.shared import written
from .domdiff import change_counts, dom_diff
from .raster import pixel_regions
from .spatial import met

#: Pixel regions come after all DOM regions of a pair.
PIXEL_FIRST = 1 << 50
TOP_REGIONS = 8


#: Regions of a pair, of either kind, that meet at once, without cells.
WHOLE = 1024
_RECT = ["ord", "x", "y", "w", "h"]


def candidate_regions(changes: DataFrame, pixels: DataFrame, whole: int = WHOLE) -> DataFrame:
    """pair_id, ord, x, y, w, h, source, changed_fields, dom_id.

    DOM changes are ``dom+pixel`` where their rectangle, as it is, overlaps a pixel region, else ``dom``; pixel
    regions that overlap no DOM change of a changed pair are ``pixel``.  Sizes are at least 1.  ``ord`` tells a pair's DOM
    changes apart, and its pixel regions.  Pairs with more than ``whole`` of either are spread over the cells of a grid; of the others, both
    kinds meet pair by pair.  Changes are written first, as they are read twice; of pixel regions, rows are counted and then read.
    """
    return _fused(written(changes, "changes"), pixels, whole)


def _fused(changes: DataFrame, pixels: DataFrame, whole: int = WHOLE) -> DataFrame:
    counts = [df.where("pair_id is not null").groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("pair_id") for df in (changes, pixels)]
    large = written(counts[0].unionByName(counts[1]).distinct(), "large")
    rest = _unmet(changes.where("pair_id is null"))  # a null pair has no other region
    changes, pixels = (df.where("pair_id is not null") for df in (changes, pixels))
    if large.isEmpty():
        return _fused_pairs(changes, pixels).unionByName(rest)
    small = [df.join(large, "pair_id", "left_anti") for df in (changes, pixels)]
    return _fused_pairs(*small).unionByName(rest).unionByName(_fused_by_cells(*(df.join(large, "pair_id", "left_semi") for df in (changes, pixels))))


def _sized(c: Callable[[str], Column]) -> list[Column]:
    """x, y, w, h as doubles, sizes of at least 1."""
    return [*(c(n).cast("double").alias(n) for n in "xy"), *(F.greatest(c(n).cast("double"), F.lit(1.0)).alias(n) for n in "wh")]


def _unmet(changes: DataFrame) -> DataFrame:
    return changes.select("pair_id", "ord", *_sized(F.col), F.lit("dom").alias("source"), "changed_fields", F.col("id").alias("dom_id"))


def _fused_pairs(changes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Of pairs with few regions: lists of both kinds, joined by pair."""

    def lists(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.groupBy("pair_id").agg(F.collect_list(F.struct(*_RECT, *more)).alias(name))

    def meets(r: Column, others: str) -> Column:
        return F.exists(F.coalesce(others, F.array()), lambda o: F.coalesce(overlap(Fields(r), Fields(o)), F.lit(False)))

    both = lists(changes, "dom", "changed_fields", "id").join(lists(pixels, "pix"), "pair_id", "left")
    kinds = changes.schema

    def from_dom(r: Column) -> Column:
        source = F.when(meets(r, "pix"), "dom+pixel").otherwise("dom").alias("source")
        return F.struct(r["ord"].alias("ord"), *_sized(r.getField), source, r["changed_fields"].alias("changed_fields"), r["id"].alias("dom_id"))

    def from_pixels(r: Column) -> Column:
        nothing = [F.lit(None).cast(kinds[c].dataType).alias(n) for c, n in (("changed_fields", "changed_fields"), ("id", "dom_id"))]
        return F.struct((r["ord"] + F.lit(PIXEL_FIRST)).alias("ord"), *_sized(r.getField), F.lit("pixel").alias("source"), *nothing)

    alone = F.filter(F.coalesce("pix", F.array()), lambda r: ~meets(r, "dom"))
    return both.select("pair_id", F.inline(F.concat(F.transform("dom", from_dom), F.transform(alone, from_pixels))))


def _fused_by_cells(changes: DataFrame, pixels: DataFrame) -> DataFrame:
    sized = _sized(F.col)
    both = met(changes, pixels).withColumn("met", F.lit(True))
    source = F.when(F.col("met"), "dom+pixel").otherwise("dom").alias("source")
    dom = changes.join(both, ["pair_id", "ord"], "left").select("pair_id", "ord", *sized, source, "changed_fields", F.col("id").alias("dom_id"))
    alone = pixels.join(met(pixels, changes), ["pair_id", "ord"], "left_anti").join(changes.select("pair_id").distinct(), "pair_id", "left_semi")
    nothing = [F.lit(None).cast(dom.schema[c].dataType).alias(c) for c in ("changed_fields", "dom_id")]
    return dom.unionByName(alone.select("pair_id", (F.col("ord") + F.lit(PIXEL_FIRST)).alias("ord"), *sized, F.lit("pixel").alias("source"), *nothing))


def detect(before: DataFrame, after: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate regions, and per pair dom_change_count, changed and pixel_region_count (counted for unchanged pairs as well).

    Both differences are made once and written.
    """
    changes, pixels = written(dom_diff(before, after), "changes"), written(pixel_regions(images), "pixels")
    counts = pixels.groupBy("pair_id").agg(F.count("*").alias("n"))
    summary = change_counts(changes, images).join(counts, "pair_id", "left").withColumn("pixel_region_count", F.coalesce("n", F.lit(0))).drop("n")
    return _fused(changes, pixels), summary


def top_regions(regions: DataFrame, k: int | Column = TOP_REGIONS) -> DataFrame:
    """The k largest regions of each pair with their rank; equal areas keep the regions' order.

    For a number k, Spark's group limit leaves k regions of a pair in each task before they are dealt out by pair, so no task ranks
    all regions of a hot pair; a k that is a column has no such limit.
    """
    order = Window.partitionBy("pair_id").orderBy(F.desc(F.col("w") * F.col("h")), "ord")
    return regions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def source_flags(regions: DataFrame) -> DataFrame:
    """How many regions of each source each pair has."""
    return regions.groupBy("pair_id").agg(*(F.count_if(F.col("source") == s).alias(n) for s, n in (("dom", "n_dom"), ("dom+pixel", "n_both"), ("pixel", "n_pixel"))))
