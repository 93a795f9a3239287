"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement.

A collection of byte strings is read in symbols of STRIDE bytes at every offset: of each string, the offsets
of one residue form a sequence of symbols of their own.  Each shard sorts its own suffixes; the merged order is
then an interleave of shard numbers, at first one shard after another.  A round moves every suffix to the
bucket of the symbol before it, keeping the order within the bucket (one LF step over all shards), after which
the interleave is right for one symbol more and the bounds between suffixes of different prefixes are known.
Common prefixes are counted as rounds without a bound; runs that share DEPTH symbols are repeated intervals.
No suffix is compared with those of other shards.
"""

from __future__ import annotations

import numpy as np

from .kernels import prefix_hash, span_hash

STRIDE, DEPTH = 100, 4


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    x = x >> 16
    while x.any():
        order = order[np.argsort((x[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        x = x >> 16
    return order


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix slots of all strings, one more than bytes each.

    Returns the first slot of each string (n + 1 values), the symbol at each slot as a rank (0 in the last
    STRIDE slots, where a sequence ends), and the symbol before it (0 where a sequence starts).
    """
    n = len(off) - 1
    first = off + np.arange(n + 1)
    size = np.diff(off)
    hashes = span_hash(prefix_hash(data), np.arange(max(len(data) - STRIDE + 1, 0)), np.arange(STRIDE, len(data) + 1))
    text = np.repeat(np.arange(n), size + 1)
    local = np.arange(first[-1]) - first[text]
    whole = np.flatnonzero(local + STRIDE <= size[text])
    ranks = np.unique(hashes[whole - text[whole]], return_inverse=True)[1] + 1
    here = np.zeros(first[-1], np.int64)
    here[whole] = ranks
    before = np.zeros(first[-1], np.int64)
    before[whole + STRIDE] = ranks
    return first, here, before


def shard_order(here: np.ndarray, a: int, b: int) -> np.ndarray:
    """The slots a ... b - 1 of one shard, sorted by their first DEPTH symbols."""
    slots = np.arange(a, b)
    keys, at = [], slots
    for _ in range(DEPTH):
        keys.append(here[at])
        at = np.where(here[at] > 0, np.minimum(at + STRIDE, b - 1), at)
    order = np.arange(b - a)
    for key in keys[::-1]:
        order = order[stable_order(key[order])]
    return slots[order]


def merge(orders: list[np.ndarray], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots in merged order, and how many symbols (DEPTH at most) each shares with the one before it."""
    slots = np.concatenate(orders)
    column = before[slots]  # the shards' transforms, one after another
    shard = np.repeat(np.arange(len(orders)), [len(o) for o in orders])
    block = np.zeros(len(slots), np.int64)
    common = np.zeros(len(slots), np.int64)
    for _ in range(DEPTH):
        place = stable_order(shard)  # where each shard's suffixes stand, in their order
        symbol = np.empty_like(column)
        symbol[place] = column
        moved = stable_order(symbol)
        symbol, block, shard = symbol[moved], block[moved], shard[moved]
        bound = np.ones(len(slots), bool)
        bound[1:] = (symbol[1:] != symbol[:-1]) | ((symbol[1:] > 0) & (block[1:] != block[:-1]))
        block = np.cumsum(bound)
        common += ~bound
    out = np.empty_like(slots)
    out[stable_order(shard)] = slots
    return out, common


def repeated(data: np.ndarray, off: np.ndarray, weight: np.ndarray, shard_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: how often the STRIDE * DEPTH bytes from it on stand in the strings, each counted ``weight`` times, and whether it is the first of these places in merged order.

    Both are 0 where fewer bytes are left of the string.
    """
    first, here, before = symbols(data, off)
    edges = [0]
    for i in range(1, len(off)):
        if first[i] - first[edges[-1]] >= shard_bytes or i == len(off) - 1:
            edges.append(i)
    orders = [shard_order(here, first[i], first[j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    slots, common = merge(orders, before)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    local = np.arange(first[-1]) - first[text]
    window = local + STRIDE * DEPTH <= np.diff(off)[text]
    interval = np.cumsum(common < DEPTH) - 1
    total = np.bincount(interval, weights=np.where(window, weight[text], 0)[slots])
    times, lead = np.zeros(first[-1], np.int64), np.zeros(first[-1], bool)
    times[slots] = total[interval]
    lead[slots[common < DEPTH]] = True
    times[~window] = 0
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    return times[inner], (lead & window)[inner]
