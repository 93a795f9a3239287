"""MinHash near-dedup with tensored banding.

Two collections of M groups of two MinHash values each give M x M table keys, every pair of a first and a
second group: 64 tables of four values from 32 evaluations instead of 256.  Documents that share a key are
candidates, and each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .kernels import U64, chunks, mix, shingle_sets, utf8
from .minhash import combined, minima
from .scratch import stored
from .session import bounded_batches
from .sieve import Sieve, rows_of, sifted

#: Groups in each of the two collections.  A pair at similarity s shares a key with probability (1 - (1 - s^2)^M)^2: 0.9994 at 0.8.
GROUPS = 8
SIGNED = "doc_id long, n_shingles long, node long, keys array<long>, " + ", ".join(f"m{i} long" for i in range(setjoin.WORDS))
#: Bytes of text whose sets are held at once.
BLOCK = 1 << 20


def node_of(items: np.ndarray) -> int:
    """64-bit identity of a set, from its sorted hashes."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def table_keys(items: np.ndarray, start: np.ndarray, groups: int) -> np.ndarray:
    """The tensored table keys of each set, one row per set."""
    values = minima(items, start, 4 * groups)
    first = [combined(values[2 * i : 2 * i + 2], 100 + i) for i in range(groups)]
    second = [combined(values[2 * (groups + j) : 2 * (groups + j) + 2], 200 + j) for j in range(groups)]
    keys = [mix(a + (b << U64(1)), 1000 + i * groups + j) for i, a in enumerate(first) for j, b in enumerate(second)]
    return np.array(keys, U64).reshape(len(keys), len(start)).T


def _signed(size: int, groups: int, carried: list[str]):
    def signed(batch):
        sets = list(shingle_sets(batch.column("text"), size))
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        keys, bits = np.zeros((0, groups * groups), U64), np.zeros((setjoin.WORDS, len(n)), np.int64)
        if len(full):
            start, items = np.r_[0, np.cumsum(n[full])[:-1]], np.concatenate([sets[i] for i in full])
            keys = table_keys(items, start, groups)
            bits = setjoin.bitmaps(items, np.repeat(np.arange(len(n)), n), len(n))
        where = np.zeros(len(n) + 1, np.int32)
        where[1:] = np.cumsum(n > 0) * groups * groups
        return pa.RecordBatch.from_arrays(
            [
                *batch.select(carried).columns,
                batch.column("doc_id"),
                pa.array(n),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(where), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))),
                *(pa.array(w) for w in bits),
            ],
            names=[*carried, *(f.split()[0] for f in SIGNED.split(", "))],
        )

    def run(batches):
        for batch in batches:
            _, off = utf8(batch.column("text"))
            for a, b in chunks(off, BLOCK):
                yield signed(batch.slice(a, b - a))

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            _, off = utf8(batch.column("text"))
            for a, b in chunks(off, BLOCK):
                sets = list(shingle_sets(batch.column("text").slice(a, b - a), size))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return run


def _labelled(rows: DataFrame, size: int, percent: int, groups: int) -> DataFrame:
    """(..., doc_id, n_shingles, node, component, component_id), one row per row (..., doc_id, text); component is a node."""
    bounded_batches(rows.sparkSession)
    carried = [c for c in rows.columns if c not in ("doc_id", "text")]
    signed = stored(rows.mapInArrow(_signed(size, groups, carried), ", ".join([*(f"{c} long" for c in carried), SIGNED])), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("keys").alias("keys"), F.min("n_shingles").alias("n"), *(F.min(f"m{i}").alias(f"m{i}") for i in range(setjoin.WORDS)))
    nodes = stored(nodes, "nodes")

    def items_of(wanted: DataFrame) -> DataFrame:
        """The set of each wanted node, read again from the text of one of its rows."""
        least = stored(nodes.select("node", "least").join(wanted, "node", "left_semi").select("least").distinct(), "least")
        texts = sifted(rows, "doc_id", Sieve(rows_of(least, "least"))).join(least.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
        if not least.where("least is null").isEmpty():
            texts = texts.unionByName(rows.where("doc_id is null"))
        sets = texts.select("text").mapInArrow(_sets(size), "node long, items binary").join(wanted, "node", "left_semi")
        return sets.dropDuplicates(["node"])

    members = setjoin.buckets(nodes)
    found = setjoin.classes(members, nodes.select("node", *setjoin.CARRIED), items_of, percent)
    labelled = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = labelled.select("node", "component").join(least, "component")
    return signed.select(*carried, "doc_id", "n_shingles", "node").join(by_node, "node", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, groups: int = GROUPS) -> DataFrame:
    """Classes of near copies: (doc_id, n_shingles, component_id, kept), one row per input row.

    Words are runs of anything but ASCII white space, A-Z lowered; a document's set is its distinct ``size``-word
    shingles, or the whole sequence if it has fewer words.  Documents are linked when 100 * intersection >=
    percent * union.  ``component_id`` is the smallest id reachable; ``kept`` marks its row(s).

    Null, empty and wordless texts have an empty set, link with nothing and are kept.  Rows with equal sets are
    one node, so repeated rows and large groups of copies cost one node.  A null id is never a component's id
    unless its component has no other.  Rows that share the smallest id and its text are all kept.  An empty
    table gives an empty table; other columns are ignored.
    """
    out = _labelled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), size, percent, groups)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, groups: int = GROUPS) -> DataFrame:
    """``docs`` with exactly one row of each class of near copies, as ``near_duplicates`` has them.

    It is that of the smallest id (null ids come last), equal ids by a hash of the row, equal rows by their place.
    Rows are told apart by their place, so null, repeated and shared ids are no exception.  Rows of an empty set stay.
    All columns of ``docs`` stay as they are, whatever their names.
    """
    placed = stored(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("row")), "placed")
    of_row = [F.col("row").getField(c) for c in (id_col, text_col)]
    rows = placed.select("__row", F.xxhash64("row").alias("__order"), of_row[0].cast("long").alias("doc_id"), of_row[1].alias("text"))
    labelled = stored(_labelled(rows, size, percent, groups).where("node is not null"), "placed-classes")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__order", "__row")
    stays = labelled.groupBy("component").agg(F.min(rank).alias("least"), F.count("*").alias("n")).where("n > 1")
    gone = labelled.join(stays.select("component", F.col("least.__row").alias("__stays")), "component").where("__row <> __stays")
    return placed.join(gone.select("__row"), "__row", "left_anti").select("row.*")
