"""A fixed-size bit table of 64-bit keys: thins rows on the executors before a join shuffles them.

Its size never depends on the data (2 MB to every task), so it may be broadcast at any scale.  It has false
positives, never false negatives: the exact join that follows gives the same rows with or without it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix

BITS = 24
_SLOT_BITS = 15  # one row of the partial tables has 4 KB


def _bit(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64), 31) >> U64(64 - BITS)).astype(np.int64)


def _marked(batches):
    table = np.zeros(1 << BITS, bool)
    for batch in batches:
        table[_bit(batch.column(0).drop_null().to_numpy(zero_copy_only=False))] = True
    rows = table.reshape(-1, 1 << _SLOT_BITS)
    full = np.flatnonzero(rows.any(axis=1))
    packed = np.packbits(rows[full], axis=1, bitorder="little")
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([r.tobytes() for r in packed], pa.binary())], names=["slot", "bits"])


def _either(table: pa.Table) -> pa.Table:
    out = np.zeros(1 << (_SLOT_BITS - 3), np.uint8)
    for bits in table.column("bits"):
        out |= np.frombuffer(bits.as_buffer(), np.uint8)
    return pa.table({"slot": table.column("slot")[:1], "bits": pa.array([out.tobytes()], pa.binary())})


class Sieve:
    """``keeps(keys)`` is true for every key of the table it was made from, and for few others."""

    def __init__(self, keys: DataFrame):
        spark = keys.sparkSession
        parts = keys.mapInArrow(_marked, "slot long, bits binary")
        whole = np.zeros((1 << (BITS - _SLOT_BITS), 1 << (_SLOT_BITS - 3)), np.uint8)
        for row in parts.groupBy("slot").applyInArrow(_either, "slot long, bits binary").collect():  # 512 rows of 4 KB at most
            whole[row.slot] = np.frombuffer(row.bits, np.uint8)
        self.table = spark.sparkContext.broadcast(whole.reshape(-1))

    def keeps(self, keys: np.ndarray) -> np.ndarray:
        at = _bit(keys)
        return (self.table.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sifted(df: DataFrame, column: str, sieve: Sieve) -> DataFrame:
    """The rows of ``df`` whose long ``column`` may be in the sieve; null never is."""

    def run(batches):
        for batch in batches:
            keys = batch.column(column)
            keep = sieve.keeps(keys.fill_null(0).to_numpy(zero_copy_only=False)) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def rows_of(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("key"))
