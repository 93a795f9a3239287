"""PNG cells to RGBA arrays and back, and scans of PNG files."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Height x width x 4 samples of an 8-bit image without interlacing."""
    if raw[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        data = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = data
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("this kind of PNG is not supported")
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, n)
    pixels = out.reshape(h, w, n)
    full = np.full((h, w, 1), 255, np.uint8)
    if head[3] == 3:
        opaque = np.full(len(palette), 255, np.uint8)
        opaque[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        return np.concatenate((palette[pixels[..., 0]], opaque[pixels]), axis=2)
    if n <= 2:
        return np.concatenate((np.repeat(pixels[..., :1], 3, axis=2), pixels[..., 1:2] if n == 2 else full), axis=2)
    return pixels if n == 4 else np.concatenate((pixels, full), axis=2)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, over = (out[i - n], up[i - n]) if i >= n else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - over
            near = [(abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - over), 2, over)]
            guess = min(near)[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode_png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image."""
    h, w = rgba.shape[:2]
    lines = np.zeros((h, 1 + 4 * w), np.uint8)
    lines[:, 1:] = rgba.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(name, content) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def with_images(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs with the contents of the files that ``before`` and ``after`` name; a missing file is an error when rows are read."""
    b, a = (images.select(F.col("name").alias(c), F.col("content").alias(f"{c}_png")) for c in ("before", "after"))
    name = F.element_at(F.split("before", "/"), -1)
    out = pairs.withColumn("before", name).withColumn("after", F.element_at(F.split("after", "/"), -1))
    out = out.join(b, "before", "left").join(a, "after", "left")
    for c in ("before", "after"):
        missing = F.raise_error(F.concat(F.lit("no such file: "), F.coalesce(c, F.lit("null")))).cast("binary")
        out = out.withColumn(f"{c}_png", F.coalesce(f"{c}_png", missing))
    return out


def write_images(images: DataFrame, folder: str) -> None:
    """(name, content) rows as files of the same names under a folder that all executors share, a file for each row."""

    def run(frames):
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with open(os.path.join(folder, os.path.basename(name)), "wb") as out:
                    out.write(content)
            yield frame[["name"]]

    images.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
