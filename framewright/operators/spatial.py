"""Rectangles that meet, found in the cells of a grid, so that a pair with very many regions is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, overlap

#: Side of a cell: most regions lie in one or two, and few of a page's regions share one.
CELL = 256


def _cell(c: Column, cell: int) -> Column:
    return F.floor(c / cell)


def in_cells(regions: DataFrame, gap: float = 0, cell: int = CELL) -> DataFrame:
    """Regions (pair_id, x, y, w, h, ...), a row for each cell (cy, cx) that they reach into, grown by ``gap`` at the right and below; rows with a null there have none."""
    out = regions
    for at, size in (("y", "h"), ("x", "w")):
        first = _cell(F.col(at), cell)
        out = out.select("*", F.explode(F.sequence(first, F.greatest(first, _cell(F.col(at) + F.col(size) + gap, cell)))).alias(f"c{at}"))
    return out


def _same_cell(gap: float) -> Column:
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("pair_id", "cy", "cx")]
    return keys[0] & keys[1] & keys[2] & overlap(Rect("a."), Rect("b."), gap)


def overlapping(left: DataFrame, right: DataFrame, gap: float = 0, cell: int = CELL) -> DataFrame:
    """Joined rows ``a`` and ``b`` of one pair whose rectangles, one of them grown by ``gap``, share more than an edge: each two of them once.

    Two rectangles that reach into several common cells are kept in that of their common area's first corner.
    """
    a, b = in_cells(left, gap, cell).alias("a"), in_cells(right, gap, cell).alias("b")
    corner = [F.col(f"a.c{c}") == _cell(F.greatest(f"a.{c}", f"b.{c}"), cell) for c in "yx"]
    return a.join(b, _same_cell(gap)).where(corner[0] & corner[1])


def met(regions: DataFrame, others: DataFrame, gap: float = 0, cell: int = CELL) -> DataFrame:
    """The distinct (pair_id, ord) of ``regions`` that overlap any of ``others``: a search that ends at the first in each cell."""
    rect = ["pair_id", "x", "y", "w", "h"]
    a, b = in_cells(regions.select("ord", *rect), gap, cell).alias("a"), in_cells(others.select(*rect), gap, cell).alias("b")
    return a.join(b, _same_cell(gap), "left_semi").select("pair_id", "ord").distinct()
