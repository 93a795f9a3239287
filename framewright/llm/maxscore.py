"""Exact top-k search by inner product with MaxScore.

A dimension is a term; its postings in a shard are the column of its components, with the shard's largest and least
component as bounds.  For a query the bound of a term is the most that it can add in that shard.  Terms are walked in
falling order of their bounds, and once the terms that are left can't lift a row to the query's k-th best score
together, they are non-essential: the postings of the essential terms alone are traversed (by a product of the
queries that have as many of them), and the other terms are probed for the rows that can still compete, some at a
time, for as long as they can.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Best, Shard, products, queries_of, searched, shards_of

#: Queries that are searched at once, and terms that are traversed or probed at once.
BLOCK, TERMS = 512, 8
#: Share of rows that can still compete up to which terms are probed row by row instead of traversed.
PROBED = 1 / 16


def _block(query: np.ndarray, places: np.ndarray, first: int, shard: Shard, columns: np.ndarray, best: Best) -> None:
    """Search a shard, whose ``columns`` are its rows turned, for a block of queries whose slots start at ``first``."""
    d, n = columns.shape
    slot = first + np.arange(len(query))
    bound = np.maximum(query * columns.max(1), query * columns.min(1)).astype(float)
    order = np.argsort(-bound.sum(0), kind="stable")
    query, columns, bound = query[:, order], columns[order], bound[:, order]
    rest = np.zeros((len(query), d + 1))
    rest[:, :-1] = np.cumsum(bound[:, ::-1], axis=1)[:, ::-1]
    least = best.least()[slot]
    weak = rest < least[:, None]
    essential = np.where(weak.any(1), weak.argmax(1), d)
    essential = np.where(essential > 0, np.minimum(-(-essential // TERMS) * TERMS, d), 0)  # 0: all terms together fall short
    _, own, itself = np.intersect1d(places, shard.place, return_indices=True)
    for e in np.unique(essential[essential > 0]).tolist():
        at = np.flatnonzero(essential == e)
        mine = np.isin(own, at)
        part = products(query[at, :e], columns[:e])
        part[np.searchsorted(at, own[mine]), itself[mine]] = -np.inf if part.dtype == float else Best.NONE // 2
        limit = least[at]
        while True:
            if e == d and n > best.k:
                limit = np.maximum(limit, np.partition(part, n - best.k, axis=1)[:, n - best.k])
            able = part + rest[at, e][:, None] >= limit[:, None]
            if e == d or able.mean() <= PROBED:
                break
            part = part + products(query[at, e : e + TERMS], columns[e : e + TERMS])
            e = min(e + TERMS, d)
        q, r = np.nonzero(able)
        score = part[q, r]
        while e < d and len(q):
            to = min(e + TERMS, d)
            score = score + (query[at[q], e:to] * columns[e:to, r].T).sum(1)
            e = to
            able = score + rest[at[q], e] >= limit[q]
            q, r, score = q[able], r[able], score[able]
        other = shard.place[r] != places[at[q]]
        q, r, score = q[other], r[other], score[other]
        best.add(slot[at[q]], score, shard.id[r], shard.place[r])


def search_cell(queries: Shard, shards: Iterator[Shard], k: int) -> Best:
    """The best k rows of the shards for each query, the query's own row aside."""
    best = Best(len(queries.id), k)
    for shard in shards:
        d = max(queries.x.shape[1], shard.x.shape[1])
        if not d:  # vectors without components: all products are 0
            queries.x, shard.x, d = np.zeros((len(queries.id), 1), np.int8), np.zeros((len(shard.id), 1), np.int8), 1
        query, columns = queries.padded(d), np.ascontiguousarray(shard.padded(d).T)
        for i in range(0, len(query), BLOCK):
            _block(query[i : i + BLOCK], queries.place[i : i + BLOCK], i, shard, columns, best)
    return best


def top_k(vectors: DataFrame, every: int, k: int = 5, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner product with each row whose id is divisible by ``every``.

    Components become floor(scale * component) (at most 2^62 in size), shorter vectors end in zeros, and scores are exact up to 2^63.
    Ties go to the smaller id.  Rows with a null id, a null vector, or a null or non-finite component take no part.
    A query's own row is no candidate of it; other rows of its id are, and each row of a repeated id is a query of its own.
    A query with fewer than k candidates returns them all; an empty table gives an empty table; other columns are ignored.
    """
    shards = shards_of(vectors, scale, id_col, vector_col)
    found = searched(shards, queries_of(shards, every), lambda q, _, held: search_cell(q, held, k), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
