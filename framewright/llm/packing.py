"""Concatenate and cut: documents laid end to end in one global id stream, cut into fixed windows.

Pass one encodes each partition once and stores the ids with their place in the partition.  The driver
adds up one token total per partition; pass two turns places into global offsets and emits a boundary
record for each window that a document touches.  Neither pass shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .kernels import binary_array, chunks, ragged, utf8
from .scratch import stored
from .session import bounded_batches

SEQUENCE, END_ID = 2048, 1
#: Bytes of text encoded at once, and ids of one output batch.
ENCODE_BYTES, BATCH_IDS = 1 << 20, 1 << 19

ENCODED = "part int, start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encode_parts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, start, doc_id, n, ids) of each row of (doc_id, text): little-endian ids, and those before it in its partition."""

    def run(batches):
        part, place, tool = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        try:
            for batch in batches:
                data, off = utf8(batch.column("text"))
                for a, b in chunks(off, ENCODE_BYTES):
                    ids, where = tool.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                    names = batch.column("doc_id").slice(a, b - a)
                    n = np.diff(where)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(b - a, part, np.int32)), pa.array(place + where[:-1]), names, pa.array(n), binary_array(ids, where)],
                        names=["part", "start", "doc_id", "n", "ids"],
                    )
                    place += len(ids)
        finally:
            tool.forget()

    return docs.mapInArrow(run, ENCODED)


def part_offsets(encoded: DataFrame) -> dict[int, int]:
    """Ids before each partition: one total per partition comes to the driver."""
    totals = sorted((r.part, r.total) for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect())
    before, out = 0, {}
    for part, total in totals:
        out[part], before = before, before + total
    return out


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents in sequences of ``sequence`` ids.

    Every sequence but the last is full.  A null or empty text has its end id only; a text of any length is
    cut wherever a window ends; repeated rows and null ids are packed like any other row.  An empty table
    gives an empty table; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    encoded = stored(encode_parts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, end_id), "encoded")
    before = part_offsets(encoded)

    def cut(batches):
        for batch in batches:
            part, start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "start", "n"))
            place = start + np.array([before[p] for p in part.tolist()], np.int64)
            upto = np.append(0, np.cumsum(n))
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4")
            for a, b in chunks(upto, BATCH_IDS):
                first, windows = place[a:b] // sequence, (place[a:b] + n[a:b] - 1) // sequence - place[a:b] // sequence + 1
                doc = np.repeat(np.arange(a, b), windows)
                window = ragged(first, windows)
                begin = np.maximum(window * sequence, place[doc])
                length = np.minimum((window + 1) * sequence, place[doc] + n[doc]) - begin
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(begin - place[doc]),
                        pa.array(length),
                        binary_array(ids[upto[a] : upto[b]], np.append(0, np.cumsum(length))),
                        pa.array(n[doc]),
                        pa.array(window),
                        pa.array(begin - window * sequence),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return encoded.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) with the ids of each sequence padded to ``sequence``: the rows a trainer reads."""
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return whole.select("sequence_id", "n_tokens", F.rpad(joined, 4 * sequence, F.lit(int(pad_id).to_bytes(4, "little"))).alias("ids"))
