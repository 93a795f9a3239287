"""Vectorised text kernels shared by the operators of this subpackage.

Every function works on the UTF-8 bytes of an Arrow string array, so a batch is cut into words,
lines or shingles without a Python loop per word.  Work is done in chunks of whole texts of about
``CHUNK_BYTES``; peak memory is a small multiple of that, or of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Powers that a worker keeps, 16 MB; those of longer buffers are made anew.
KEPT_POWERS = (1 << 20) + 1
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for first, last in separators:
        table[first : last + 1] = False
    return table


#: Letters and digits of any script: the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lowered.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Anything but ASCII white space: the class ``[^\\x20\\x09-\\x0D]``.
NON_SPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Anything but a line feed.
NON_NEWLINE = _class([(0x0A, 0x0A)])


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    off = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes each; a longer text stands alone."""
    limit, first, n = limit or CHUNK_BYTES, 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, min(2 * len(_powers[0]), KEPT_POWERS))
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        if size > KEPT_POWERS:
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes, one more than there are bytes."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODES[data] * p[: len(data)], out=out[1:], dtype=U64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, from the prefix hashes of their buffer; equal bytes, equal hash."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64), seed)


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class within each text: starts, ends, and first run of each text (n + 1 values)."""
    inside = table[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lowered, and the first word of each text (n + 1 values)."""
    data = LOWER[data]
    start, end, first = spans(data, off, table)
    return span_hash(prefix_hash(data), start, end), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words by their starting word, and which of them lie within one text.

    The entry of a word too near the end of its text is not meaningful.
    """
    n = len(words)
    out = np.zeros(n, U64)
    if n >= size:
        run = np.zeros(n - size + 1, U64)
        for k in range(size):
            run = run * U64(_BASE) + words[k : n - size + 1 + k]
        out[: n - size + 1] = mix(run, 7)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return out, left >= size


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence of any length, its length included."""
    run = 0
    for w in words.tolist():
        run = (run * _BASE + w) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([run], U64), 11 + len(words))[0])


def shingle_sets(texts, size: int, table: np.ndarray = NON_SPACE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``size`` words, or of the whole sequence if it has fewer."""
    data, off = utf8(texts)
    for a, b in chunks(off):
        part, where = data[off[a] : off[b]], off[a : b + 1] - off[a]
        words, first = word_hashes(part, where, table)
        shingles, _ = shingle_hashes(words, first, size)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= size:
                yield np.unique(shingles[i : j - size + 1])
            elif j > i:
                yield np.array([sequence_hash(words[i:j])], U64)
            else:
                yield np.zeros(0, U64)


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow binary array of consecutive slices of a contiguous numpy array, ``off`` in its elements."""
    where = (np.asarray(off, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] ... start[i] + size[i] - 1 of all i, one after another."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
