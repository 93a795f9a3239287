"""Minima of 32-bit hash functions over hash sets, whole batches at once."""

from __future__ import annotations

import numpy as np

from .kernels import U64, chunks, mix


#: Items that are hashed at once: their arrays stay in a core's own cache.
BLOCK = 1 << 17


def minima(items: np.ndarray, start: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash values (rows) of each non-empty set; ``start`` has the first item of each set."""
    out = np.empty((count, len(start)), np.uint32)
    if not len(start):
        return out
    half = (items >> U64(32)).astype(np.uint32)
    factors = np.random.default_rng(seed).integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    off = np.append(start, len(items))
    for a, b in chunks(off, BLOCK):
        part, first = half[off[a] : off[b]], off[a:b] - off[a]
        work = np.empty_like(part)
        for k, factor in enumerate(factors):
            np.multiply(part, factor, out=work)
            out[k, a:b] = np.minimum.reduceat(work, first)
    return out


def combined(rows: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit value of the given MinHash rows, for each place of the other axes."""
    out = np.zeros(rows.shape[1:], U64)
    for k, row in enumerate(rows):
        out = mix(out + row.astype(U64), seed + k)
    return out
