"""Token ids in binary files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of consecutive documents.  Its layout, all little-endian:

    magic "PFR1" | n_docs u32 | n_ids u32 | n_blocks u32 | n_exceptions u32
    documents:  ids i64[n_docs], null flags u8[n_docs], lengths u32[n_docs]
    blocks:     payload starts u32[n_blocks], exception starts u32[n_blocks], minima u32[n_blocks], widths u8[n_blocks]
    exceptions: places u8[n_exceptions], high parts u32[n_exceptions]
    payload:    BLOCK values of the block's width each, low bit first, block after block

Each block of BLOCK ids subtracts its minimum and packs the low bits at the width that holds PERCENTILE of
its values; the high bits of the others are exceptions.  Files travel as binary cells of Parquet tables, so
any store that Spark reaches can hold them; ``export`` writes them out one by one.
"""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .kernels import binary_array, chunks, utf8
from .packing import part_offsets
from .scratch import stored
from .session import bounded_batches

BLOCK, PERCENTILE, END_ID = 128, 90, 2
#: Bytes of text in a file, unless one text is longer.
FILE_BYTES = 1 << 22
MAGIC = b"PFR1"
FILES = "part int, file int, start long, n long, content binary"


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """payload starts, exception starts, minima, widths, exception places, exception high parts, payload."""
    n = len(ids)
    count = -(-n // BLOCK)
    padded = np.full(count * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    grid = padded.reshape(count, BLOCK)
    low = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    at = BLOCK * PERCENTILE // 100
    width = bit_lengths(np.partition(rest, at, axis=1)[:, at]) if count else np.zeros(0, np.int64)
    high = rest >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width >= 32] = 0
    block, place = np.nonzero(high)
    starts = np.append(0, np.cumsum(width * (BLOCK // 8)))
    payload = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = ((rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        payload[starts[rows][:, None] + np.arange(w * BLOCK // 8)] = packed
    return starts[:-1].astype("<u4"), np.searchsorted(block, np.arange(count)).astype("<u4"), low.astype("<u4"), width.astype("u1"), place.astype("u1"), high[block, place].astype("<u4"), payload


def decode_blocks(n: int, starts, firsts, low, width, place, high, payload) -> np.ndarray:
    count = len(starts)
    rest = np.zeros((count, BLOCK), np.uint32)
    starts = starts.astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = payload[starts[rows][:, None] + np.arange(w * BLOCK // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        rest[rows] = value
    block = np.repeat(np.arange(count), np.diff(np.append(firsts, len(place)).astype(np.int64)))
    rest[block, place] |= high << width[block].astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)[:n]


def write_file(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    parts = encode_blocks(ids)
    head = struct.pack("<4I", len(doc_ids), len(ids), len(parts[0]), len(parts[4]))
    names = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1")
    return b"".join([MAGIC, head, names.tobytes(), nulls.tobytes(), lengths.astype("<u4").tobytes(), *(p.tobytes() for p in parts)])


def read_file(content) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a file of ``write_file``."""
    raw = memoryview(content)
    if bytes(raw[:4]) != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, exceptions = struct.unpack("<4I", raw[4:20])
    place, out = 20, []
    for kind, many in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("<u4", blocks), ("<u4", blocks), ("u1", blocks), ("u1", exceptions), ("<u4", exceptions)):
        out.append(np.frombuffer(raw, kind, many, place))
        place += out[-1].nbytes
    payload = np.frombuffer(raw, "u1", -1, place) if place < len(raw) else np.zeros(0, "u1")
    return pa.array(out[0], mask=out[1].astype(bool)), out[2].astype(np.int64), decode_blocks(n, *out[3:], payload)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (part, file, start, n, content) of token files; files in the order (part, file) hold the documents in ascending id order.

    Null ids come first; rows of equal ids are ordered by their text's hash.  A null or empty text has its end
    id only.  A file holds about FILE_BYTES of text, or one longer text.  An empty table gives no file;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        part, file, place, tool = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for a, b in chunks(off, FILE_BYTES):
                ids, where = tool.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                content = write_file(batch.column("doc_id").slice(a, b - a), np.diff(where), ids)
                row = {"part": (part, pa.int32()), "file": (file, pa.int32()), "start": (place, pa.int64()), "n": (len(ids), pa.int64()), "content": (content, pa.binary())}
                yield pa.RecordBatch.from_pydict({name: pa.array([value], kind) for name, (value, kind) in row.items()})
                file, place = file + 1, place + len(ids)

    return stored(ordered.mapInArrow(run, FILES), "token-files", "none")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files; ``start`` counts the ids of all documents before it."""
    before = part_offsets(files)  # a number per partition

    def run(batches):
        for batch in batches:
            for part, start, content in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("content"), strict=True):
                names, lengths, ids = read_file(content.as_buffer())
                where = np.append(0, np.cumsum(lengths))
                yield pa.RecordBatch.from_arrays([names, pa.array(before[part] + start + where[:-1]), pa.array(lengths), binary_array(ids, where)], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def export(files: DataFrame, folder: str) -> int:
    """Write the files one by one to a folder of the driver's machine; returns how many."""
    count = 0
    for row in files.orderBy("part", "file").toLocalIterator():
        Path(folder, f"tokens-{row.part:05d}-{row.file:05d}.pfr").write_bytes(row.content)
        count += 1
    return count

