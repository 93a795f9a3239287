"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M - |x|^2) for rows (M being the shard's largest squared norm) and 0 for anchors, the
squared distance of an anchor a and a row x is |a|^2 + M - 2 a.x.  So a window of scores is an annulus of distances,
and the best scores are the nearest rows in it.  Each shard has a tree: a node's vantage point parts its rows at the
median distance, and the least and largest distance of either part bound how near and how far the rows of a leaf
can be.  An anchor's leaves are visited nearest first, those outside of the annulus are passed over, and the outer
radius shrinks to the k-th best score that was found; the walk ends at the first leaf beyond it.  Distances only
choose leaves; scores are compared as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .vectors import Best, Shard, products, queries_of, searched, shards_of

#: Rows of a leaf at most, and anchors that walk at once.
LEAF, BLOCK = 64, 1024
#: Distances may be off by this share of the largest.
SLACK = 1e-6
NONE, ANY = Best.NONE, (1 << 63) - 1


def _levels(n: int) -> int:
    return max(0, int(np.ceil(np.log2(n / LEAF)))) if n else 0


def edges_of(n: int) -> np.ndarray:
    """Where the leaves of a tree of n rows begin, and n: halves of halves."""
    edges = np.array([0, n])
    for _ in range(_levels(n)):
        edges = np.insert(edges, np.arange(1, len(edges)), (edges[:-1] + edges[1:]) // 2)
    return edges


def with_tree(shard: Shard) -> Shard:
    """The shard's rows in the order of a tree's leaves, and the tree: for each node its vantage point's row and the range of distances on either side."""
    x, n = shard.x.astype(float), len(shard.id)
    norm = (x * x).sum(1)
    lift = np.sqrt(norm.max() - norm)
    rows, nodes = np.arange(n), []
    edges = [0, n]
    for _ in range(_levels(n)):
        cut = [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part, mid = rows[a:b], (a + b) // 2

            def away(point: int, part: np.ndarray = part) -> np.ndarray:
                return np.sqrt(((x[part] - x[point]) ** 2).sum(1) + (lift[part] - lift[point]) ** 2)

            point = part[away(part[0]).argmax()]  # at a rim, where distances differ most
            distance = away(point)
            order = np.argsort(distance, kind="stable")
            rows[a:b], distance = part[order], distance[order]
            nodes.append((point, distance[0], distance[mid - a - 1], distance[mid - a], distance[-1]))
            cut += [mid, b]
        edges = cut
    at = np.empty(n, np.int64)
    at[rows] = np.arange(n)
    tree = np.array([(at[p], *d) for p, *d in nodes], float).reshape(-1, 5)
    return Shard(shard.place[rows], shard.id[rows], shard.label[rows], shard.x[rows], tree.tobytes())


def leaf_ranges(query: np.ndarray, rows: np.ndarray, tree: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance that each leaf's rows can have from each query; ``base`` is |q|^2 + M."""
    low, high = np.zeros((len(query), 1)), np.full((len(query), 1), np.inf)
    if not len(tree):
        return low, high
    d = np.sqrt(np.maximum(base[:, None] - 2 * products(query, rows[tree[:, 0].astype(np.int64)].T), 0))
    first = 0
    while first < len(tree):
        here, part = d[:, first : first + low.shape[1]], tree[first : first + low.shape[1]]
        sides = [(np.maximum(low, np.maximum(here - part[:, j + 1], part[:, j] - here)), np.minimum(high, here + part[:, j + 1])) for j in (1, 3)]
        first += low.shape[1]
        low, high = (np.stack((sides[0][i], sides[1][i]), axis=2).reshape(len(query), -1) for i in (0, 1))
    return low, high


def _walk(q: Shard, query: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, shard: Shard, rows: np.ndarray, best: Best, same: bool) -> None:
    """Visit a shard's leaves for a block of anchors; ``low`` and ``high`` (anchors x windows) bound the scores, a slot each."""
    m, windows = low.shape
    slot = first * windows + np.arange(m * windows).reshape(m, windows)
    tree, edges = np.frombuffer(shard.tree, float).reshape(-1, 5), edges_of(len(rows))
    base = (query.astype(float) ** 2).sum(1) + (rows.astype(float) ** 2).sum(1).max()
    slack = SLACK * np.sqrt(base)
    near, far = leaf_ranges(query, rows, tree, base)
    turn = np.argsort(near, axis=1, kind="stable")
    for r in range(turn.shape[1]):
        leaf = turn[:, r]
        least = np.maximum(low, best.score[slot, -1])
        able = least <= high
        outer = np.sqrt(np.maximum(base - 2 * np.where(able, least, ANY).min(1).astype(float), 0)) + slack
        inner = np.sqrt(np.maximum(base - 2 * np.where(able, high, NONE).max(1).astype(float), 0)) - slack
        each = np.arange(m)
        open_ = able.any(1) & (near[each, leaf] <= outer)
        if not open_.any():
            break
        go = np.flatnonzero(open_ & (far[each, leaf] >= inner))
        found = []
        for k in np.unique(leaf[go]).tolist():
            at, part = go[leaf[go] == k], slice(edges[k], edges[k + 1])
            score = products(query[at], rows[part].T).astype(np.int64)
            fits = ((q.label[at][:, None] == shard.label[part]) == same) & (q.place[at][:, None] != shard.place[part])
            for w in range(windows):
                a, x = np.nonzero(fits & (score >= least[at, w][:, None]) & (score <= high[at, w][:, None]))
                found.append((slot[at[a], w], score[a, x], shard.id[part][x], shard.place[part][x]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))


def search_cell(q: Shard, low: np.ndarray, high: np.ndarray, shards: Iterator[Shard], k: int, same: bool) -> Best:
    """The best k rows within each window of each anchor, of the anchor's own label or of any other one."""
    best = Best(low.size, k)
    for shard in shards:
        d = max(q.x.shape[1], shard.x.shape[1])
        query, rows = q.padded(d), shard.padded(d)
        for i in range(0, len(query), BLOCK):
            part = slice(i, i + BLOCK)
            _walk(q.take(np.arange(len(query))[part]), query[part], low[part], high[part], i, shard, rows, best, same)
    return best


def lowest(score: int, percent: int) -> int:
    """The least whole number s with percent * score <= 100 * s."""
    return max(NONE, -((-percent * score) // 100))


def mine(vectors: DataFrame, every: int, positives: int = 5, k: int = 5, percent: int = 80, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: str | F.Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows whose id is divisible by ``every``.

    Components become floor(scale * component), scores are inner products, higher ones come first, ties by smaller id.
    An anchor's positives are its first ``positives`` other rows of its label; the negatives of a positive are the first
    ``k`` rows of other labels with percent * positive_score <= 100 * negative_score <= 100 * positive_score, so there
    are none where the positive's score is below zero.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.  Shorter vectors end in zeros.
    Rows are told apart by their place, so each row of a repeated id is an anchor, a positive or a negative of its own.
    Anchors without positives, and positives without negatives, have no row; an empty table gives an empty table; other columns are ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    shards = shards_of(vectors, scale, id_col, vector_col, label, with_tree)
    anchors = stored(queries_of(shards, every), "anchors")

    def alike(q: Shard, _: pa.Table, held: Iterator[Shard]) -> Best:
        whole = np.full((len(q.id), 1), NONE)
        return search_cell(q, whole, np.full_like(whole, ANY), held, positives, True)

    near = stored(searched(shards, anchors, alike, positives), "positives")
    lists = near.groupBy("query_place").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = stored(anchors.join(lists.select(F.col("query_place").alias("place"), F.col("p.score").alias("high")), "place"), "windows")

    def unlike(q: Shard, table: pa.Table, held: Iterator[Shard]) -> Best:
        low, high = np.zeros((len(q.id), positives), np.int64), np.full((len(q.id), positives), -1)  # an empty window
        for i, scores in enumerate(table.column("high").to_pylist()):
            high[i, : len(scores)] = scores
            low[i, : len(scores)] = [lowest(s, percent) for s in scores]
        return search_cell(q, low, high, held, k, False)

    found = searched(shards, asked, unlike, k, positives).select("query_place", "query_id", "rank", (F.col("slot") + 1).alias("p_rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("query_place", F.col("rank").cast("long").alias("p_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(pairs, ["query_place", "p_rank"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
