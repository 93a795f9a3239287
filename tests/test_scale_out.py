"""What spreads one pair over tasks: tiles of masks, cells of boxes, and components over their seams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import connect, fusion, raster, spatial

BOX = "pair_id long, ord long, x long, y long, w long, h long, changed_pixels long"


def rows_of(df):
    return sorted((r.pair_id, r.x, r.y, r.w, r.h, r.changed_pixels) for r in df.collect())


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 100)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300), (None, 3), (5, None), (1, 0), (0, 1)]
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(60, 101), 60), **dict.fromkeys(range(200, 207), 200)}
    assert {r.node: r.component for r in connect.connected(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert connect.connected(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("tile", [3, 8, 512])
def test_tiles_give_what_whole_masks_give(spark, tile):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for pair, share in enumerate((0.3, 0.55, 0.65, 0.9)):
        y, x = np.nonzero(rng.random((17, 22)) < share)
        rows += [(pair, int(a), int(b)) for a, b in zip(x, y, strict=True)]
        want += [(pair, *map(int, b)) for b in raster.components(y, x)]
    spiral = [(9, x, y) for y in range(0, 16, 2) for x in range(16)] + [(9, 15 if y % 4 == 1 else 0, y) for y in range(1, 15, 2)]
    df = spark.createDataFrame([*rows, *spiral, *spiral[:9], (None, 1, 1)], "pair_id long, x long, y long")
    out = raster.mask_components(df, tile)
    assert rows_of(out) == sorted([*want, (9, 0, 0, 16, 15, len(spiral))])
    first = {(r.pair_id, r.ord) for r in out.collect()}
    assert first == {(p, min(y << 32 | x for x, y in zip(*part, strict=True))) for p, part in _parts([*rows, *spiral])}


def _parts(rows):
    """Plain flood fill: (pair, (xs, ys)) of every component."""
    left, out = set(rows), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            p, x, y = todo.pop()
            seen.append((x, y))
            for q in ((p, x - 1, y), (p, x + 1, y), (p, x, y - 1), (p, x, y + 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append((p, tuple(zip(*seen, strict=True))))
    return out


def test_no_mask_lies_in_one_task(spark):
    pixels = spark.range(1 << 16).select(F.lit(1).cast("long").alias("pair_id"), (F.col("id") % 256).alias("x"), F.floor(F.col("id") / 256).alias("y"))
    assert rows_of(raster.mask_components(pixels, 32)) == [(1, 0, 0, 256, 256, 1 << 16)]


@pytest.mark.parametrize("cell", [20, 90, 1024])
def test_cells_give_what_whole_pairs_give(spark, cell, monkeypatch):
    monkeypatch.setattr(raster, "HELD", 16)
    rng = np.random.default_rng(7)
    rows, want = [], []
    for pair, (n, far) in enumerate(((1, 9), (30, 300), (120, 1500))):
        boxes = np.c_[rng.integers(0, far, (n, 2)), rng.integers(0, 40, (n, 2)), rng.integers(1, 9, n)]
        rows += [(pair, i, *map(int, b)) for i, b in enumerate(boxes)]
        want += [(pair, *map(int, b)) for b in raster.merge_boxes(boxes)]
    df = spark.createDataFrame([*rows, (None, 0, 1, 1, 1, 1, 1)], BOX)
    out = raster.merged_regions(df, cell=cell)
    assert rows_of(out) == sorted(want)
    firsts = {(r.pair_id, r.ord): r for r in out.collect()}
    for pair, i, x, y, w, h, _ in rows:
        near = [o for (p, o), r in firsts.items() if p == pair and r.x <= x and r.y <= y and x + w <= r.x + r.w and y + h <= r.y + r.h]
        assert min(near) <= i
    assert rows_of(raster.merged_regions(df.drop("ord"), cell=cell)) == sorted(want)


def test_empty_masks_and_boxes(spark):
    assert raster.mask_components(spark.createDataFrame([], "pair_id long, x long, y long")).collect() == []
    assert raster.merged_regions(spark.createDataFrame([], BOX)).collect() == []


def test_overlaps_are_found_once(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: [(int(rng.integers(0, 2)), i, *(float(v) for v in rng.integers(-50, 300, 2) + 0.5), *(float(v) for v in rng.integers(0, 90, 2))) for i in range(n)]
    schema = "pair_id long, ord long, x double, y double, w double, h double"
    left, right = draw(60), draw(50)
    a, b = spark.createDataFrame([*left, (1, 99, None, 0.0, 1.0, 1.0)], schema), spark.createDataFrame(right, schema)
    for gap in (0, 8):
        want = sorted((p[0], p[1], q[1]) for p in left for q in right if p[0] == q[0] and all(p[i] < q[i] + q[i + 2] + gap and q[i] < p[i] + p[i + 2] + gap for i in (2, 3)))
        assert sorted(map(tuple, spatial.overlapping(a, b, gap, 64).select("a.pair_id", "a.ord", "b.ord").collect())) == want
        assert sorted(map(tuple, spatial.met(a, b, gap, 64).collect())) == sorted({w[:2] for w in want})


def test_a_hot_pair_is_fused(spark):
    """A pair of 100,000 DOM changes and as many pixel regions, half of which meet."""
    n = 100_000
    at = [(F.col("id") % 1000 * 40).cast("double").alias("x"), (F.floor(F.col("id") / 1000) * 40).cast("double").alias("y")]
    size = [F.lit(9.0).alias("w"), F.lit(9.0).alias("h")]
    changes = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").alias("ord"), *at, *size, F.array(F.lit("rect")).alias("changed_fields"), F.lit("n").alias("id"))
    pixels = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").alias("ord"), (at[0] + F.when(F.col("id") % 2 == 0, 4).otherwise(20)).alias("x"), at[1], *size)
    regions = fusion.candidate_regions(changes, pixels)
    assert {r.source: r["count"] for r in regions.groupBy("source").count().collect()} == {"dom+pixel": n // 2, "dom": n // 2, "pixel": n // 2}
    top = fusion.top_regions(regions, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")  # 3 regions a task are dealt out
    assert [r.ord for r in top.orderBy("rank").collect()] == [0, 1, 2]
