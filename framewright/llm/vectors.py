"""Vectors of whole numbers in packed shards, searched by a query set, a cell of queries and shards at a time.

Shards are Arrow batches of the scan, packed as one row each and stored.  Queries are rows of the shards.  A grid
deals both out: queries by a hash into groups of ``QUERIES``, shards by a hash into parts of some ``ROWS`` rows, and
every group meets every part in one cell of bounded size.  A cell keeps the best k rows of each of its queries; the
lists of the cells are merged by a window whose limit Spark applies before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .session import batches_of, bounded_batches

#: Rows of a shard at most; queries and rows of a cell, on average.
SHARD, QUERIES, ROWS = 4096, 16384, 1 << 18
#: Cells that a small table is still cut into.
LEAST_PARTS = 24
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
#: Entries beyond this count as this.
LARGEST = float(1 << 62)

SHARDS = "shard long, rows long, width int, places binary, ids binary, labels binary, x binary, tree binary"


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists that are whole, and their values as rows of doubles; shorter rows end in zeros.

    Null lists and lists that hold nulls, NaN or infinities are no whole lists.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.filter(lists.is_valid())
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    flat = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(there)), size)
    whole = np.bincount(owner, ~np.isfinite(flat), len(there)) == 0
    out = np.zeros((len(there), int(size.max()) if len(size) else 0))
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return there[whole], out[whole]


def whole_numbers(values: np.ndarray, scale: float, shift: int = 0) -> np.ndarray:
    """floor(scale * value) + shift as 64-bit numbers."""
    return np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64) + shift


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them all."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers held as doubles or longs: by doubles where no sum can leave their exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return a.astype(float, copy=False) @ b.astype(float, copy=False)
    return a.astype(np.int64) @ b.astype(np.int64)


@dataclass
class Shard:
    """Rows of vectors: their places in the table, ids, labels (0 where there are none) and whole numbers; and a tree over them, if one was made."""

    place: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    tree: bytes = b""

    def packed(self, number: int) -> dict:
        x = narrow(self.x)
        return {"shard": number, "rows": len(self.id), "width": x.itemsize, "places": self.place.tobytes(), "ids": self.id.tobytes(), "labels": self.label.tobytes(), "x": x.tobytes(), "tree": self.tree}

    @classmethod
    def unpacked(cls, row: dict) -> Shard:
        place, id_, label = (np.frombuffer(row[c], np.int64) for c in ("places", "ids", "labels"))
        return cls(place, id_, label, np.frombuffer(row["x"], f"i{row['width']}").reshape(len(place), -1), row["tree"])

    def padded(self, d: int) -> np.ndarray:
        """Rows of d doubles, or of longs where doubles aren't exact."""
        out = np.zeros((len(self.x), d), np.int64 if self.x.dtype == np.int64 else float)
        out[:, : self.x.shape[1]] = self.x
        return out

    def take(self, at: np.ndarray) -> Shard:
        return Shard(self.place[at], self.id[at], self.label[at], self.x[at])


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in fields], names=[n for n, _ in fields])


def shards_of(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, arranged: Callable[[Shard], Shard] = lambda s: s) -> DataFrame:
    """SHARDS of the rows with an id, a whole vector and, where ``label`` is given, a label; stored, so that places stay.

    ``arranged`` may order the rows of a shard and give it a tree.
    """
    bounded_batches(vectors.sparkSession)
    kept = vectors.select(
        F.monotonically_increasing_id().alias("place"),
        F.col(id_col).cast("long").alias("id"),
        (F.lit(0) if label is None else label).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"),
    ).where("id is not null and label is not null")

    def run(batches):
        for batch in batches:
            at, values = matrix(batch.column("x"))
            if len(at):
                shard = Shard(*(batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("place", "id", "label")), whole_numbers(values, scale))
                yield _table([arranged(shard).packed(int(shard.place[0]))], SHARDS)

    with batches_of(vectors.sparkSession, SHARD):
        return stored(kept.mapInArrow(run, SHARDS), "shards")


QUERY = "place long, id long, label long, width int, x binary"


def queries_of(shards: DataFrame, every: int) -> DataFrame:
    """QUERY rows of the shards' rows whose id is divisible by ``every``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard.unpacked(row)
                at = np.flatnonzero(s.id % every == 0)
                part = s.take(at)
                yield _table([{"place": int(p), "id": int(i), "label": int(k), "width": s.x.itemsize, "x": v.tobytes()} for p, i, k, v in zip(part.place, part.id, part.label, part.x, strict=True)], QUERY)

    return shards.mapInArrow(run, QUERY)


def query_shard(table: pa.Table) -> Shard:
    """All queries of a cell."""
    rows = [np.frombuffer(x, f"i{w}") for x, w in zip(table.column("x").to_pylist(), table.column("width").to_pylist(), strict=True)]
    x = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return Shard(*(table.column(c).to_numpy().astype(np.int64) for c in ("place", "id", "label")), narrow(x))


class Best:
    """The best k rows (score, id, place) of each slot: highest scores first, ties by smaller id, then place."""

    NONE = -(1 << 63)

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), self.NONE)
        self.id, self.place = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to enter each slot, as a double: minus infinity where there is room."""
        last = self.score[:, -1]
        return np.where(last == self.NONE, -np.inf, last.astype(float))

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, place: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        held = self.score[touched] != self.NONE
        owner = np.broadcast_to(touched[:, None], held.shape)[held]
        columns = [np.concatenate((a, b)) for a, b in ((owner, slot), (self.score[touched][held], score.astype(np.int64)), (self.id[touched][held], id_), (self.place[touched][held], place))]
        order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
        slot, score, id_, place = (c[order] for c in columns)
        new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot))))
        kept = rank < self.k
        at = slot[kept], rank[kept]
        self.score[at], self.id[at], self.place[at] = score[kept], id_[kept], place[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score, id and place of all that is held."""
        slot, _ = there = np.nonzero(self.score != self.NONE)
        return slot, self.score[there], self.id[there], self.place[there]


FOUND = "query_place long, query_id long, slot long, place long, id long, score long"


def searched(shards: DataFrame, queries: DataFrame, kernel: Callable[[Shard, pa.Table, Iterator[Shard]], Best], k: int, slots: int = 1) -> DataFrame:
    """(query_place, query_id, slot, rank, place, id, score): the best k rows of each slot of each query, over all shards.

    ``kernel`` searches the shards of a cell for its queries and gives a ``Best`` with ``slots`` slots for each
    query.  It also sees the table of queries, for columns beyond QUERY.
    """
    spark = shards.sparkSession
    rows = shards.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    groups = max(1, -(-queries.count() // QUERIES))
    parts = max(1, min(-(-rows // SHARD), max(LEAST_PARTS, -(-rows // ROWS))))
    dealt = queries.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = shards.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in FOUND.split(", ")]
        q = query_shard(asked)
        found = kernel(q, asked, (Shard.unpacked(row) for row in held.to_pylist())) if len(asked) and len(held) else Best(0, k)
        slot, score, id_, place = found.rows()
        at = slot // slots
        return pa.table([pa.array(c) for c in (q.place[at], q.id[at], slot % slots, place, id_, score)], names=names)

    bounded_batches(spark)
    cells = dealt.groupBy("group", "part").cogroup(spread.groupBy("group", "part")).applyInArrow(run, FOUND)
    order = Window.partitionBy("query_place", "slot").orderBy(F.desc("score"), "id", "place")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
