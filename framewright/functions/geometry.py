"""Rectangle predicates and arithmetic as column expressions; a rectangle is four columns with a common prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layout tolerance, gap of merging, share of the frame below which a region is noise, crop padding, IoU of a hit.
TOLERANCE, GAP, LEAST_SHARE, PADDING, HIT = 1, 8, 0.001, 16, 0.3


class Rect:
    """Columns x, y, w, h after ``prefix``, or fields of the struct column that ``prefix`` names with a dot."""

    def __init__(self, prefix: str = ""):
        self.x, self.y, self.w, self.h = (F.col(prefix + c) for c in "xywh")

    @property
    def area(self) -> Column:
        return self.w * self.h


class Fields(Rect):
    """The fields x, y, w, h of a struct, as of an array's entry."""

    def __init__(self, struct: Column):
        self.x, self.y, self.w, self.h = (struct[c] for c in "xywh")


def round_half_up(c: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(c + F.lit(0.5))


def moved(a: Rect, b: Rect, tolerance: float = TOLERANCE) -> Column:
    """Whether any of place and size differs by more than the tolerance."""
    return F.greatest(*(F.abs(getattr(a, c) - getattr(b, c)) for c in "xywh")) > tolerance


def overlap(a: Rect, b: Rect, gap: float = 0) -> Column:
    """Whether the rectangles, one of them grown by ``gap``, share more than an edge."""
    return (a.x < b.x + b.w + gap) & (b.x < a.x + a.w + gap) & (a.y < b.y + b.h + gap) & (b.y < a.y + a.h + gap)


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 for disjoint rectangles and empty unions."""
    wide = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    tall = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    shared = (F.greatest(wide, F.lit(0)) * F.greatest(tall, F.lit(0))).cast("double")
    union = a.area + b.area - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def crop_window(r: Rect, width: Column, height: Column, padding: int = PADDING) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of a padded crop; padding that an edge cuts off at the left or top is not taken off the size."""
    x, y = F.greatest(r.x - padding, F.lit(0)), F.greatest(r.y - padding, F.lit(0))
    return x, y, F.least(width - x, r.w + 2 * padding), F.least(height - y, r.h + 2 * padding)


def large_enough(r: Rect, width: Column, height: Column, share: float = LEAST_SHARE) -> Column:
    return r.area >= width * height * F.lit(share)


def bounding_box(prefix: str = "") -> list[Column]:
    """Aggregates x, y, w, h of the least rectangle around all of a group, rounded; null for an empty group."""
    r = Rect(prefix)
    x, y = F.min(r.x), F.min(r.y)
    return [round_half_up(c).cast("bigint").alias(n) for c, n in ((x, "x"), (y, "y"), (F.max(r.x + r.w) - x, "w"), (F.max(r.y + r.h) - y, "h"))]
