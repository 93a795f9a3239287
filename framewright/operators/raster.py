"""Pixel differences: change masks, connected regions by tiles, and merging of near boxes by cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import GAP, LEAST_SHARE
from ..sources.png import decode_png
from ..sources.shared import written
from .connect import connected

THRESHOLD = 0.15
#: Luma and chroma weights of the YIQ space, weights of their squared differences, the largest difference.
YIQ = {"y": (0.29889531, 0.58662247, 0.11448223), "i": (0.59597799, -0.2741761, -0.32180189), "q": (0.21147017, -0.52261711, 0.31114694)}
YIQ_WEIGHTS = {"y": 0.5053, "i": 0.299, "q": 0.1957}
LARGEST_DELTA = 35215.0


def colour_delta(before: str = "b_", after: str = "a_") -> Column:
    """Weighted squared YIQ distance of two opaque colours in columns r, g, b after the prefixes."""
    out = F.lit(0.0)
    for part, weights in YIQ.items():
        d = sum((F.lit(w) * (F.col(before + c) - F.col(after + c)) for w, c in zip(weights, "rgb", strict=True)), F.lit(0.0))
        out = out + F.lit(YIQ_WEIGHTS[part]) * d * d
    return out


def pixel_changed(before: str = "b_", after: str = "a_", threshold: float = THRESHOLD) -> Column:
    return colour_delta(before, after) > F.lit(LARGEST_DELTA * threshold * threshold)


def _blend(rgba: np.ndarray) -> np.ndarray:
    """Colours over white."""
    alpha = rgba[..., 3:4].astype(float) / 255
    return 255 + (rgba[..., :3].astype(float) - 255) * alpha


#: The eight neighbours of a pixel.
_AROUND = [(v, u) for v in (-1, 0, 1) for u in (-1, 0, 1) if (v, u) != (0, 0)]


def _on_edge(shape: tuple[int, int], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (y == 0) | (x == 0) | (y == shape[0] - 1) | (x == shape[1] - 1)


def _neighbours(shape: tuple[int, int], y: np.ndarray, x: np.ndarray):
    """Places of each neighbour of all given pixels, and which of them lie in the frame; others stand in as the pixel itself."""
    for v, u in _AROUND:
        inside = (y + v >= 0) & (y + v < shape[0]) & (x + u >= 0) & (x + u < shape[1])
        yield np.where(inside, y + v, y), np.where(inside, x + u, x), inside


def _plain(rgba: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which pixels share their colour with more than two neighbours; the frame's edge counts as one."""
    same = _on_edge(rgba.shape[:2], y, x).astype(np.int64)
    for v, u, inside in _neighbours(rgba.shape[:2], y, x):
        same += inside & (rgba[v, u] == rgba[y, x]).all(axis=1)
    return same > 2


def _luma(rgba: np.ndarray) -> np.ndarray:
    """Sums of products, so that equal colours have equal values wherever they stand."""
    colours = _blend(rgba)
    return sum(w * colours[..., i] for i, w in enumerate(YIQ["y"]))


def _smoothed(rgba: np.ndarray, other: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which pixels lie on a smoothed edge: between darker and lighter neighbours, one of which is part of a plain area in both images."""
    luma = _luma(rgba)
    equal = _on_edge(luma.shape, y, x).astype(np.int64)
    darkest, lightest = np.zeros(len(y)), np.zeros(len(y))
    dark, light = np.stack((y, x)), np.stack((y, x))
    for v, u, inside in _neighbours(luma.shape, y, x):
        d = np.where(inside, luma[y, x] - luma[v, u], np.nan)
        equal += d == 0
        lower, higher = d < darkest, d > lightest
        darkest, lightest = np.where(lower, d, darkest), np.where(higher, d, lightest)
        dark, light = np.where(lower, (v, u), dark), np.where(higher, (v, u), light)
    out = (equal <= 2) & (darkest < 0) & (lightest > 0)
    at = np.flatnonzero(out)
    plain = [_plain(rgba, *side[:, at]) & _plain(other, *side[:, at]) for side in (dark, light)]
    out[at] = plain[0] | plain[1]
    return out


def change_mask(before: np.ndarray, after: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Changed pixels of two RGBA images of one size, smoothed edges left out."""
    if before.shape != after.shape:
        raise ValueError(f"image sizes differ: {before.shape[:2]} and {after.shape[:2]}")
    d = _blend(before) - _blend(after)
    delta = sum(YIQ_WEIGHTS[k] * (d @ np.array(w)) ** 2 for k, w in YIQ.items())
    mask = delta > LARGEST_DELTA * threshold * threshold
    y, x = np.nonzero(mask)
    mask[y, x] = ~(_smoothed(before, after, y, x) | _smoothed(after, before, y, x))
    return mask


def row_runs(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows (y, first x, last x) of the runs of sorted pixels."""
    new = np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(y) - 1]
    return np.stack((y[new], x[new], x[last]), axis=1)


def labelled_runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a set of pixels in raster order, and of each run the first run of its 4-connected component."""
    if not len(y):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    order = np.lexsort((x, y))
    runs = row_runs(y[order], x[order])
    root = list(range(len(runs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = {int(v): (int(a), int(b)) for v, a, b in zip(*(lambda u, i: (u, i, np.r_[i[1:], len(runs)]))(*np.unique(runs[:, 0], return_index=True)), strict=True)}
    for v, (a, b) in at.items():
        j, end = at.get(v - 1, (0, 0))
        for i in range(a, b):
            while j < end and runs[j, 2] < runs[i, 1]:
                j += 1
            k = j
            while k < end and runs[k, 1] <= runs[i, 2]:
                p, q = find(i), find(k)
                root[max(p, q)] = min(p, q)
                k += 1
    return runs, np.array([find(i) for i in range(len(runs))])


def run_boxes(runs: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (x, y, w, h, pixels) of labelled runs, and the first run of each."""
    first, group = np.unique(label, return_inverse=True)
    x0, y0 = runs[first, 1].copy(), runs[first, 0]
    x1, y1, pixels = np.zeros(len(first), np.int64), y0.copy(), np.zeros(len(first), np.int64)
    np.minimum.at(x0, group, runs[:, 1])
    np.maximum.at(x1, group, runs[:, 2] + 1)
    np.maximum.at(y1, group, runs[:, 0] + 1)
    np.add.at(pixels, group, runs[:, 2] - runs[:, 1] + 1)
    return np.stack((x0, y0, x1 - x0, y1 - y0, pixels), axis=1).astype(np.int64).reshape(-1, 5), first


def components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Boxes (x, y, w, h, pixels) of the 4-connected components of a set of pixels, in the order of their first pixels."""
    return run_boxes(*labelled_runs(y, x))[0]


def _linked(rows: np.ndarray, gap: int) -> np.ndarray:
    """Of each box, the least number of a box that it is near to, through others as well: a sweep over sorted left edges."""
    order = np.argsort(rows[:, 0], kind="stable")
    left, n = rows[order, 0], len(rows)
    reach = np.searchsorted(left, left + rows[order, 2] + gap, "left")
    count = np.maximum(reach - np.arange(n) - 1, 0)
    upto = np.append(0, np.cumsum(count))
    pairs, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + _SWEEP, "right")) - 1)
        a = np.repeat(np.arange(i, j), count[i:j])
        b = a + 1 + np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], count[i:j])
        p, q = rows[order[a]], rows[order[b]]
        near = (p[:, 0] < q[:, 0] + q[:, 2] + gap) & (p[:, 1] < q[:, 1] + q[:, 3] + gap) & (q[:, 1] < p[:, 1] + p[:, 3] + gap)
        pairs.append(np.stack((order[a[near]], order[b[near]])))
        i = j
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _boxes_around(rows: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The box around the boxes of each group, and their pixels; ``first`` has a row of each."""
    x0, y0 = rows[first, 0], rows[first, 1]
    x1, y1, pixels = x0.copy(), y0.copy(), np.zeros(len(first), np.int64)
    np.minimum.at(x0, group, rows[:, 0])
    np.minimum.at(y0, group, rows[:, 1])
    np.maximum.at(x1, group, rows[:, 0] + rows[:, 2])
    np.maximum.at(y1, group, rows[:, 1] + rows[:, 3])
    np.add.at(pixels, group, rows[:, 4])
    return np.stack((x0, y0, x1 - x0, y1 - y0, pixels), axis=1)


#: Pairs of boxes that are compared at once.
_SWEEP = 1 << 16


def merge_boxes(boxes: np.ndarray, gap: int = GAP) -> np.ndarray:
    """Boxes with pixel counts, near ones replaced by the box around them until none are near, in the order of their first boxes."""
    rows = np.asarray(boxes, np.int64).reshape(-1, 5)
    while len(rows):
        label = _linked(rows, gap)
        first, group = np.unique(label, return_inverse=True)
        if len(first) == len(rows):
            break
        rows = _boxes_around(rows, first, group)
    return rows


BOXES = "pair_id bigint, ord bigint, x bigint, y bigint, w bigint, h bigint, changed_pixels bigint"


def _frame(key, boxes: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(boxes, columns=["x", "y", "w", "h", "changed_pixels"])
    out.insert(0, "ord", range(len(out)))
    out.insert(0, "pair_id", key)
    return out


#: Sides of the tiles in which masks are labelled, and of the cells in which boxes meet.
TILE, CELL = 512, 1024
#: Rows of one group that are held before they are shrunk.
HELD = 1 << 18
_BOX = ["x", "y", "w", "h", "changed_pixels"]


def _in_groups(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, shrink: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Whole groups of rows of whole numbers, dealt out by ``keys`` and sorted, answered by ``f``.

    ``f`` takes rows and the first of each group (n + 1 values).  Tasks walk their groups in a stream; what is held of a
    group beyond HELD rows is replaced by ``shrink`` of it, fewer rows that mean the same.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return _walked(dealt, len(keys), f, schema, shrink)


def _walked(rows: DataFrame, n: int, f: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str, shrink: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``_in_groups`` of rows whose groups, by their first ``n`` columns, stand together already."""
    names = rows.columns

    def edges(values: np.ndarray) -> np.ndarray:
        return np.r_[0, np.flatnonzero((values[1:, :n] != values[:-1, :n]).any(1)) + 1, len(values)]

    def run(frames):
        held = np.zeros((0, len(names)), np.int64)
        for frame in frames:
            held = np.concatenate((held, frame[names].to_numpy(np.int64)))
            if not len(held):
                continue
            last = edges(held)[-2]
            if last:
                yield f(held[:last], edges(held[:last]))
                held = held[last:]
            if len(held) > HELD:
                held = shrink(held)
        if len(held):
            yield f(held, edges(held))

    return rows.mapInPandas(run, schema)


#: Rows of tiles: components, and the pixels beside a seam, which ``seam`` numbers from the pixel at its right or below.
_TILED = "pair_id bigint, first bigint, x bigint, y bigint, w bigint, h bigint, changed_pixels bigint, upright boolean, seam bigint"


def _place(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number for a pixel, in raster order."""
    return (y << 32) | x


def _once(rows: np.ndarray) -> np.ndarray:
    """Sorted rows without repeats."""
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)]]


def _tile(tile: int):
    """Rows _TILED of pixels (pair_id, ty, tx, y, x), tile by tile: all tiles are labelled at once, as bands with a row between them."""

    def answer(rows: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        pair, ty, tx = rows[edges[:-1], :3].T
        band = tile + 1
        once = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
        runs, label = labelled_runs((rows[:, 3] - ty[group] * tile + group * band)[once], rows[once, 4])
        boxes, first = run_boxes(runs, label)
        at = runs[:, 0] // band  # the tile of each run
        y = runs[:, 0] - at * band + ty[at] * tile
        boxes[:, 1] = y[first]
        place = _place(y, runs[:, 1])
        left, right = (runs[:, 1] == tx[at] * tile) & (tx[at] > 0), runs[:, 2] == tx[at] * tile + tile - 1
        seams = [(np.flatnonzero(on), y[on], x[on], True) for on, x in ((left, runs[:, 1]), (right, runs[:, 2] + 1))]
        for on, below in (((y == ty[at] * tile) & (ty[at] > 0), 0), (y == ty[at] * tile + tile - 1, 1)):
            run = np.flatnonzero(on)
            size = runs[run, 2] - runs[run, 1] + 1
            each = np.repeat(run, size)
            seams.append((each, y[each] + below, runs[each, 1] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size), False))
        run, sy, sx, upright = (np.concatenate([np.broadcast_to(v[i], len(v[0])) for v in seams]) for i in range(4))
        n, m = len(first), len(run)
        columns = {"pair_id": np.r_[pair[at[first]], pair[at[run]]], "first": np.r_[place[first], place[label[run]]]}
        gap = pd.array([pd.NA] * m, "Int64")
        columns |= {c: pd.concat([pd.Series(v, dtype="Int64"), pd.Series(gap)], ignore_index=True) for c, v in zip(_BOX, boxes.T, strict=True)}
        columns["upright"] = pd.concat([pd.Series([pd.NA] * n, dtype="boolean"), pd.Series(upright, dtype="boolean")], ignore_index=True)
        columns["seam"] = pd.concat([pd.Series([pd.NA] * n, dtype="Int64"), pd.Series(_place(sy, sx), dtype="Int64")], ignore_index=True)
        return pd.DataFrame(columns)

    return answer


def mask_components(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """BOXES of the connected components of each pair's changed pixels (pair_id, x, y), whose coordinates are from 0 to 2^31 - 1.

    A mask is cut into tiles of ``tile`` x ``tile`` pixels, which are labelled apart; what touches across the seams of tiles is
    joined by distributed components, so no mask lies in one task.  ``ord`` is the place of a component's first pixel, y * 2^32 + x.
    Rows of a null pair are ignored, repeated pixels count once.
    """
    p = pixels.where("pair_id is not null").select("pair_id", *(F.floor(F.col(c) / tile).alias(f"t{c}") for c in "yx"), *(F.col(c).cast("bigint").alias(c) for c in "yx"))
    found = written(_in_groups(p, ["pair_id", "ty", "tx"], ["y", "x"], _tile(tile), _TILED, _once), "tiles")
    boxes = found.where("seam is null").select("pair_id", F.col("first").alias("ord"), *_BOX)
    ends = found.where("seam is not null").groupBy("pair_id", "upright", "seam").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    edges = written(ends.select(*(F.struct("pair_id", F.col(c).alias("first")).alias(n) for c, n in (("b", "u"), ("a", "v")))).distinct(), "seams")
    if edges.isEmpty():
        return boxes
    whole = connected(edges).select(F.col("node.pair_id").alias("pair_id"), F.col("node.first").alias("ord"), F.col("component.first").alias("root"))
    return _around(boxes.join(whole, ["pair_id", "ord"], "left").withColumn("root", F.coalesce("root", "ord")).drop("ord").withColumn("ord", F.col("root")), "root").drop("root")


def _around(boxes: DataFrame, root: str) -> DataFrame:
    """The box around all boxes of a root, their pixels and their least ``ord``."""
    x0, y0 = F.min("x"), F.min("y")
    sums = [x0.alias("x"), y0.alias("y"), (F.max(F.col("x") + F.col("w")) - x0).alias("w"), (F.max(F.col("y") + F.col("h")) - y0).alias("h"), F.sum("changed_pixels").alias("changed_pixels")]
    return boxes.groupBy("pair_id", root).agg(F.min("ord").alias("ord"), *sums)


def _apart(boxes: np.ndarray, group: np.ndarray, gap: int) -> tuple[np.ndarray, int]:
    """Boxes moved so far to the right, by a multiple for each group, that none of different groups are near; and how far."""
    out = boxes.copy()
    wide = int((out[:, 0] + out[:, 2]).max() - out[:, 0].min() + gap + 1)
    out[:, 0] += group * wide
    return out, wide


def _merged_apart(rows: np.ndarray, keys: int, gap: int) -> np.ndarray:
    """Rows (keys..., ord, box) of sorted groups, merged within each."""
    new = np.r_[True, (rows[1:, :keys] != rows[:-1, :keys]).any(1)]
    group = np.cumsum(new) - 1
    merged, wide = _apart(rows[:, keys + 1 :], group, gap)
    label = np.arange(len(rows))
    while True:
        step = _linked(merged, gap)
        first, to = np.unique(step, return_inverse=True)
        label = to[label]
        if len(first) == len(merged):
            break
        merged = _boxes_around(merged, first, to)
    ord_ = np.full(len(merged), np.iinfo(np.int64).max)
    np.minimum.at(ord_, label, rows[:, keys])
    at = np.empty(len(merged), np.int64)
    at[label[::-1]] = np.arange(len(rows))[::-1]
    merged[:, 0] -= group[at] * wide
    return np.concatenate((rows[at, :keys], ord_[:, None], merged), axis=1)


_KEYED = ["pair_id", "cy", "cx", "ord", *_BOX]


def _homed(boxes: DataFrame, cell: int) -> DataFrame:
    return boxes.select("pair_id", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"), "ord", *_BOX)


def _merge_at_home(boxes: DataFrame, cell: int, gap: int) -> DataFrame:
    """Boxes with near ones of one cell merged; they are merged batch by batch before they are dealt out, as the order of merging doesn't matter."""
    schema = ", ".join(f"{c} bigint" for c in _KEYED)

    def combine(frames):
        for frame in frames:
            if len(frame):
                rows = frame[_KEYED].to_numpy(np.int64)
                yield pd.DataFrame(_merged_apart(rows[np.lexsort(rows.T[::-1])], 3, gap), columns=_KEYED)

    def merged(rows: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(_merged_apart(rows, 3, gap), columns=_KEYED)

    few = _homed(boxes, cell).mapInPandas(combine, schema)
    return _in_groups(few, ["pair_id", "cy", "cx"], ["ord"], merged, schema, lambda rows: _merged_apart(rows, 3, gap))


#: Boxes of a pair that are merged at once, without cells.
WHOLE = 4096


def merged_regions(boxes: DataFrame, gap: int = GAP, cell: int = CELL, whole: int = WHOLE) -> DataFrame:
    """BOXES after merging, of (pair_id, x, y, w, h, changed_pixels) in whole numbers: near ones replaced by the box around them until none are near.

    Pairs of at most ``whole`` boxes, which are counted first, are merged pair by pair, where they lie if they lie by pair already.  Of
    other pairs, boxes of one cell of ``cell`` x ``cell`` are merged first.  Then, round by round, boxes meet in all cells that they reach into,
    distributed components join those that are near, and what has grown meets others in the next round, until a round finds nothing.  So such a pair's
    boxes are spread over tasks, and a cell is held as merged boxes.  ``ord`` is the least of what was merged, or
    y * 2^32 + x of the first box where the input has none.  Rows of a null pair are ignored.
    """
    rows = boxes.where("pair_id is not null").withColumns({c: F.col(c).cast("bigint") for c in _BOX})
    rows = rows if "ord" in boxes.columns else rows.withColumn("ord", F.col("y") * (1 << 32) + F.col("x"))
    large = written(rows.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("pair_id"), "large")
    if large.isEmpty():
        return _merged_pairs(rows, gap, whole)
    return _merged_pairs(rows.join(large, "pair_id", "left_anti"), gap, whole).unionByName(_merged_by_cells(rows.join(large, "pair_id", "left_semi"), gap, cell))


def _merged_pairs(rows: DataFrame, gap: int, whole: int) -> DataFrame:
    """BOXES of pairs of at most ``whole`` boxes.  The count in a window brings a pair's rows together, and no shuffle where they are."""
    together = rows.select("pair_id", "ord", *_BOX, F.count("*").over(Window.partitionBy("pair_id")).alias("n")).where(F.col("n") <= whole)

    def merged(values: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(_merged_apart(values, 1, gap), columns=["pair_id", "ord", *_BOX])

    return _walked(together.drop("n"), 1, merged, BOXES, lambda values: _merged_apart(values, 1, gap))


def _merged_by_cells(rows: DataFrame, gap: int, cell: int) -> DataFrame:
    now = written(_merge_at_home(rows, cell, gap).drop("cy", "cx").withColumn("id", F.monotonically_increasing_id()), "boxes")
    while True:
        ends = {c: (F.floor(F.col(c) / cell), F.floor((F.col(c) + F.greatest(F.col(s) + gap, F.lit(1)) - 1) / cell)) for c, s in (("x", "w"), ("y", "h"))}
        reach = [F.explode(F.sequence(*ends[c])).alias(f"c{c}") for c in "yx"]
        abroad = now.where((ends["x"][0] < ends["x"][1]) | (ends["y"][0] < ends["y"][1]))
        spread = now.select("*", reach[0]).select("*", reach[1])
        visited = abroad.select("*", reach[0]).select("pair_id", "cy", reach[1]).distinct()
        meet = spread.join(visited, ["pair_id", "cy", "cx"], "left_semi").select("pair_id", "cy", "cx", "id", *_BOX)

        def near(values: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
            label = _linked(_apart(values[:, 4:], np.repeat(np.arange(len(edges) - 1), np.diff(edges)), gap)[0], gap)
            linked = label != np.arange(len(values))
            return pd.DataFrame({"u": values[linked, 3], "v": values[label[linked], 3]})

        edges = written(_in_groups(meet, ["pair_id", "cy", "cx"], ["id"], near, "u bigint, v bigint", lambda rows: rows), "near")
        if edges.isEmpty():
            return now.select("pair_id", "ord", *_BOX)
        roots = connected(edges).withColumnRenamed("node", "id")
        grown = now.join(roots, "id", "left").withColumn("id", F.coalesce("component", "id")).drop("component")
        now = written(_around(grown, "id"), "boxes")


def image_regions(mask: np.ndarray, share: float = LEAST_SHARE, gap: int = GAP) -> np.ndarray:
    """Components whose box is large enough for the frame, merged."""
    y, x = np.nonzero(mask)
    found = components(y, x)
    return merge_boxes(found[found[:, 2] * found[:, 3] >= mask.size * share], gap)


def pixel_regions(images: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """BOXES of PNG pairs (pair_id, before, after); a pair without a changed pixel has no row."""

    def run(frames):
        for frame in frames:
            parts = [_frame(k, image_regions(change_mask(decode_png(b), decode_png(a), threshold))) for k, b, a in zip(frame["pair_id"], frame["before"], frame["after"], strict=True)]
            yield pd.concat([_frame(0, np.zeros((0, 5), np.int64)), *parts])

    return images.select("pair_id", "before", "after").mapInPandas(run, BOXES)


def changed_pixels(images: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(pair_id, x, y) of the changed pixels of PNG pairs (pair_id, before, after), smoothed edges left out: what ``mask_components`` takes."""

    def run(frames):
        for frame in frames:
            for key, before, after in zip(frame["pair_id"], frame["before"], frame["after"], strict=True):
                y, x = np.nonzero(change_mask(decode_png(before), decode_png(after), threshold))
                yield pd.DataFrame({"pair_id": np.full(len(y), key, np.int64), "x": x, "y": y})

    return images.select("pair_id", "before", "after").mapInPandas(run, "pair_id bigint, x bigint, y bigint")
