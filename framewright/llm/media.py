"""Media columns: Netpbm and BMP cells decoded to numpy arrays, area-resized, written as NPY tiles and difference hashes.

Area resizing reads integral images: the rows of the integral image that the output's edges need are summed
once, and each output cell is a difference of four (interpolated) corners.  Images of any height take memory
of a few times their own bytes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

#: Width of the images that hold texts, and sizes of tiles and hashes.
TEXT_WIDTH, TILE = 64, 16
_HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+")
_NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary 8-bit grey map (P5) of a two-dimensional array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey (two dimensions) or 24-bit RGB (three) BMP."""
    h, w = samples.shape[:2]
    grey = samples.ndim == 2
    row = -(-w * (1 if grey else 3) // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * (1 if grey else 3)] = (samples if grey else samples[:, :, ::-1].reshape(h, -1))[::-1]
    palette = (np.arange(256, dtype=np.uint32) * 0x010101).astype("<u4").tobytes() if grey else b""
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0) + palette + body.tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Height x width (x 3) samples of a P1 to P6 map; 8 bits, or 16 where the largest value needs them."""
    head = _HEAD.match(raw)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, at, sizes = int(head[1]), head.end(), []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _NUMBER.match(raw, at)
        if not m:
            raise ValueError("the header breaks off")
        sizes.append(int(m[1]))
        at = m.end()
    w, h, most = (*sizes, 1)[:3]
    deep = 3 if kind in (3, 6) else 1
    shape = (h, w, 3) if deep == 3 else (h, w)
    if not 0 < most < 65536:
        raise ValueError("bad largest value")
    if kind == 4:
        row = -(-w // 8)
        bits = np.frombuffer(raw, np.uint8, h * row, at + 1).reshape(h, row)
        return ((1 - np.unpackbits(bits, axis=1)[:, :w]) * 255).astype(np.uint8)
    if kind >= 5:
        out = np.frombuffer(raw, np.uint8 if most < 256 else ">u2", h * w * deep, at + 1).reshape(shape)
        return out if most < 256 else out.astype(np.uint16)
    body = re.sub(rb"#[^\n]*", b"", raw[at:])
    if kind == 1:
        out = (1 - np.array([c - 48 for c in body if c in b"01"][: h * w], np.uint8)) * 255
    else:
        out = np.array(body.split()[: h * w * deep], np.int64).astype(np.uint8 if most < 256 else np.uint16)
    return out.reshape(shape)


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height x width (x 3) samples of an uncompressed BMP of 8, 24 or 32 bits; a grey palette gives two dimensions."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a BMP image")
    start, size, w, h, _, bits, packing = *struct.unpack("<I", raw[10:14]), *struct.unpack("<IiiHHI", raw[14:34])
    if packing or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("this kind of BMP is not supported")
    deep, tall = bits // 8, abs(h)
    row = -(-w * deep // 4) * 4
    grid = np.frombuffer(raw, np.uint8, tall * row, start).reshape(tall, row)[:, : w * deep]
    if h > 0:
        grid = grid[::-1]
    if deep > 1:
        return grid.reshape(tall, w, deep)[:, :, 2::-1]
    used = struct.unpack("<I", raw[46:50])[0] or 256
    palette = np.frombuffer(raw, np.uint8, 4 * used, 14 + size).reshape(used, 4)
    if (palette[:, :3] == np.arange(used, dtype=np.uint8)[:, None]).all():
        return grid
    return palette[grid][:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each output cell (float64), from the integral image."""
    h, w = image.shape[:2]
    flat = image.reshape(h, w, -1)
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    edges = np.unique(np.concatenate((np.floor(y), np.ceil(y)))).astype(np.int64)
    rows = np.zeros((len(edges), w, flat.shape[2]), np.int64)  # the integral image's rows at the edges
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        rows[i + 1] = rows[i] + flat[a:b].sum(axis=0, dtype=np.int64)
    whole = np.concatenate((np.zeros((len(edges), 1, flat.shape[2]), np.int64), np.cumsum(rows, axis=1)), axis=1)
    low, high = np.floor(y).astype(np.int64), np.ceil(y).astype(np.int64)
    part = (y - low)[:, None, None]
    tall = whole[np.searchsorted(edges, low)] * (1 - part) + whole[np.searchsorted(edges, high)] * part
    low, high = np.floor(x).astype(np.int64), np.ceil(x).astype(np.int64)
    part = (x - low)[None, :, None]
    corner = tall[:, low] * (1 - part) + tall[:, high] * part
    cell = np.diff(np.diff(corner, axis=0), axis=1)
    out = cell / (np.diff(y)[:, None, None] * np.diff(x)[None, :, None])
    return out.reshape(height, width) if image.ndim == 2 else out


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hexadecimal digits: of 8 x 9 area means, which are less than their right neighbours."""
    small = np.round(grey(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


FEATURES = [("height", pa.int32(), "int"), ("width", pa.int32(), "int"), ("tile", pa.binary(), "binary"), ("dhash", pa.string(), "string"), ("error", pa.string(), "string")]


def features(media: DataFrame, column: str = "media", tile: int = TILE, extra=None, extra_schema: list[tuple[str, pa.DataType, str]] = ()) -> DataFrame:
    """The rows of ``media`` without ``column``, but with height, width, an NPY tile of tile x tile area means, a difference hash and error.

    A null or undecodable cell has nulls and the error's text.  ``extra(image)`` may add columns of its own,
    null where there is an error.  Equal cells get equal values; other columns stay, but for those of the new names.
    """
    bounded_batches(media.sparkSession)
    new = [*FEATURES, *extra_schema]
    kept = [c for c in media.columns if c != column and c not in {n for n, _, _ in new}]

    def one(cell):
        if cell is None:
            return (None, None, None, None, "null", *(None for _ in extra_schema))
        try:
            image = decode(cell)
            small = area_resize(image, tile, tile)
        except (ValueError, struct.error, IndexError) as e:
            return (None, None, None, None, str(e), *(None for _ in extra_schema))
        return (*image.shape[:2], npy(np.rint(small).astype(image.dtype)), difference_hash(image), None, *(extra(image) if extra else ()))

    def run(batches):
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *(pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(new))], names=[*kept, *(n for n, _, _ in new)])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*kept).schema]
    return media.mapInArrow(run, ", ".join([*schema, *(f"`{n}` {t}" for n, _, t in new)]))


def text_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, as a grey map TEXT_WIDTH wide, zero bytes filling its last row.

    An empty text is one row of zeros.  Repeated rows stay; an empty table gives an empty table; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            cells = [encode_pgm(np.frombuffer(x.ljust(max(1, -(-len(x) // TEXT_WIDTH)) * TEXT_WIDTH, b"\0"), np.uint8).reshape(-1, TEXT_WIDTH)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAYLOAD = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long")]


def payload_digests(image: np.ndarray) -> tuple[int, str, int]:
    raw = image.tobytes()
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])
