"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard checks and distributed union-find.

A line is what stands between line feeds, white space at its ends and case of A-Z aside.  Its set is its
distinct substrings of SHINGLE code points, or the whole line if it is shorter.  Lines of BANDS bands of ROWS MinHash
values that share a band are candidates; links have 100 * intersection >= percent * union on the full sets;
of each component of linked lines the first occurrence, by document and line number, stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .kernels import LOWER, NON_NEWLINE, NON_SPACE, U64, binary_array, chunks, mix, prefix_hash, ragged, span_hash, spans, utf8
from .minhash import combined, minima
from .scratch import drop, stored
from .session import bounded_batches
from .sieve import Sieve, rows_of, sifted

#: A pair at similarity s shares a band with probability 1 - (1 - s**5)**16: 0.998 at 0.8, 0.999999 at 0.9.
SHINGLE, ROWS, BANDS, PERCENT = 5, 5, 16, 80
BASE = U64(0x9E3779B97F4A7C15)
SQUARE = U64(pow(0x9E3779B97F4A7C15, 2, 1 << 64))
#: Bytes of text cut at once: the arrays stay in a core's own cache.
BLOCK = 1 << 18
_STEPS = 16
LINES = "doc_id long, doc_hash long, line int, node long, keys binary, items binary"
HELD = "node long, items binary, n long, " + ", ".join(f"m{i} long" for i in range(setjoin.WORDS))


def trimmed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end (white space at the ends aside), document and number of every line that isn't blank."""
    start, end, _ = spans(data, off, NON_NEWLINE)
    solid: np.ndarray | None = None  # places of all that isn't white space; made only for long runs of white space
    at = np.flatnonzero(~NON_SPACE[data[start]])
    for _ in range(_STEPS):
        start[at] += 1
        at = at[start[at] < end[at]]
        at = at[~NON_SPACE[data[start[at]]]]
    if len(at):
        solid = np.flatnonzero(NON_SPACE[data])
        start[at] = np.minimum(np.append(solid, len(data))[np.searchsorted(solid, start[at])], end[at])
    some = start < end
    start, end = start[some], end[some]
    at = np.flatnonzero(~NON_SPACE[data[end - 1]])
    for _ in range(_STEPS):
        end[at] -= 1
        at = at[~NON_SPACE[data[end[at] - 1]]]
    if len(at):
        solid = np.flatnonzero(NON_SPACE[data]) if solid is None else solid
        end[at] = solid[np.searchsorted(solid, end[at]) - 1] + 1
    doc = np.searchsorted(off, start, "right") - 1
    feeds = np.flatnonzero(data == 10)
    return start, end, doc, np.searchsorted(feeds, start) - np.searchsorted(feeds, off[doc])


def shingle_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, line by line with repeats, and the first of each line (n + 1 values)."""
    data = LOWER[data]
    lead = (data & 0xC0) != 0x80  # where code points begin
    if lead.all():
        codes, at, chars = data.astype(U64), start, end - start
    else:
        heads = np.flatnonzero(lead)
        codes = data[heads].astype(U64)
        wide = np.flatnonzero(codes >= 0xC0)
        padded, size = np.append(data, np.zeros(4, np.uint8)), np.append(heads, len(data))[wide + 1] - heads[wide]
        bytes_of = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))[heads[wide]]
        codes[wide] = bytes_of & (np.uint32(0xFFFFFFFF) >> (32 - 8 * size).astype(np.uint32))
        at = np.searchsorted(heads, start)
        chars = np.searchsorted(heads, end) - at
    many = np.maximum(chars - SHINGLE + 1, 1)
    first = np.append(0, np.cumsum(many))
    whole = chars >= SHINGLE
    if whole.all():
        return _taken(_runs(codes), at, many), first
    out = np.zeros(first[-1], U64)
    if whole.any():
        out[np.repeat(whole, many)] = _taken(_runs(codes), at[whole], many[whole])
    for size in range(1, SHINGLE):
        short = np.flatnonzero(chars == size)
        value = np.zeros(len(short), U64)
        for k in range(size):
            value = value * BASE + codes[at[short] + k]
        out[first[short]] = mix(value, 6 + size)
    return out, first


def _taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[ragged(start, size)]``: by a mask where the runs come in order and don't meet."""
    if (start[1:] < start[:-1] + size[:-1]).any():
        return values[ragged(start, size)]
    edge = np.zeros(len(values) + 1, np.int8)
    edge[start] += 1
    edge[start + size] -= 1
    return values[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]


def _runs(codes: np.ndarray) -> np.ndarray:
    """Hashes of SHINGLE code points from each place on: a polynomial of them, its bits mixed."""
    two = codes[:-1] * BASE
    two += codes[1:]
    run = two[:-2] * SQUARE
    run += two[2:]
    run = run[: len(codes) - 4] * BASE
    run += codes[4:]
    work = run >> U64(32)
    run ^= work
    run *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(run, U64(29), out=work)
    run ^= work
    return run


def distinct_shingles(hashes: np.ndarray, first: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each line, and the first of each (n + 1 values); all lines are sorted at once.

    Shingles are told apart by the 64 - ``bits`` bits that the line's number leaves, the others become 0.
    """
    n = len(first) - 1
    bits = U64(bits or max(n.bit_length(), 1))
    owner = np.repeat(np.arange(n, dtype=U64), np.diff(first))
    both = np.sort((owner << (U64(64) - bits)) | (hashes >> bits))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both << bits, np.searchsorted(both >> (U64(64) - bits), np.arange(n + 1, dtype=U64))


def line_items(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of stored lines, and the first of each line (n + 1 values); equal cells are hashed once."""
    coded = cells.dictionary_encode()
    data, off = utf8(coded.dictionary.cast(pa.string()))
    items, first = distinct_shingles(*shingle_hashes(data, off[:-1], off[1:]), setjoin.PAIR_BITS)
    row = coded.indices.to_numpy(zero_copy_only=False)
    size = np.diff(first)[row]
    return items[ragged(first[row], size)], np.append(0, np.cumsum(size))


def _chunks(batches):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, b in chunks(off, BLOCK):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


def _nodes(data, start, end) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[data]), start, end, 3).view(np.int64)


def _cut(batches):
    """LINES rows; only the first of equal lines of a chunk has keys and its text."""
    for part, data, off in _chunks(batches):
        start, end, doc, number = trimmed(data, off)
        node = _nodes(data, start, end)
        index = np.sort(np.unique(node, return_index=True)[1])  # in the order of the text
        keys = np.zeros((0, BANDS), np.int64)
        if len(index):
            items, first = distinct_shingles(*shingle_hashes(data, start[index], end[index]))
            values = minima(items, first[:-1], ROWS * BANDS)
            bands = combined(values.reshape(BANDS, ROWS, -1).swapaxes(0, 1), 300)
            keys = mix(bands + np.arange(BANDS, dtype=U64)[:, None], 2000).T.view(np.int64)
        fresh = np.zeros(len(node), bool)
        fresh[index] = True
        own = binary_array(np.ascontiguousarray(keys).reshape(-1), np.append(0, np.cumsum(fresh) * BANDS))
        raw = data.tobytes()
        cells = [raw[a:b] if f else None for a, b, f in zip(start.tolist(), end.tolist(), fresh.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(doc)), part.column("doc_hash").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(node), own, pa.array(cells, pa.binary())],
            names=[f.split()[0] for f in LINES.split(", ")],
        )


def _held(batches):
    """HELD rows of rows (node, items): with the size and bitmap of each line's set."""
    for batch in batches:
        for part, items, first in setjoin.parts(batch, line_items):
            size = np.diff(first)
            bits = setjoin.bitmaps(items, np.repeat(np.arange(len(size)), size), len(size))
            yield pa.RecordBatch.from_arrays([*part.select(["node", "items"]).columns, pa.array(size), *(pa.array(w) for w in bits)], names=[f.split()[0] for f in HELD.split(", ")])


def _removed(kept: list[str], text_col: str, without: Sieve | None = None):
    """The rows without the lines in ``__gone``; documents in the sieve ``without`` are left out."""

    def run(batches):
        for batch in batches:
            if without:
                batch = batch.filter(pa.array(~without.keeps(batch.column("hash").to_numpy(zero_copy_only=False))))
            row = dict(zip(kept, batch.column("row").flatten(), strict=True))
            if without:  # nothing goes: lines are counted without cutting texts
                lines = np.where(pc.equal(pc.binary_length(row[text_col]), 0).fill_null(True), 0, pc.add(pc.count_substring(row[text_col], "\n"), 1).fill_null(0))
                yield pa.RecordBatch.from_arrays([*row.values(), pa.array(lines.astype(np.int64)), pa.array(np.zeros(len(lines), np.int64))], names=[*kept, "n_lines", "n_removed"])
                continue
            texts, lines, many = [], [], []
            for text, gone in zip(row[text_col].to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                cut = set(gone or ())
                parts = text.split("\n") if text else []
                lines.append(len(parts))
                many.append(len(cut))
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in cut) if cut else text)
            columns = row | {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in kept), pa.array(lines, pa.int64()), pa.array(many, pa.int64())], names=[*kept, "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without their repeated lines, and n_lines (before) and n_removed.

    Blank lines are never removed.  The first occurrence of a component is that of the smallest (id, text's
    hash, line number); rows with the same id and text keep or lose the same lines.  Null texts stay null,
    empty ones empty, and a text that loses all its lines becomes empty; null ids come first.  An empty table
    gives an empty table; other columns stay, but for those of the new names.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("doc_hash"), F.col(text_col).alias("text")).where("text is not null")
    lines = stored(named.mapInArrow(_cut, LINES), "lines")
    several = stored(lines.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "occurrences")
    members = setjoin.buckets(lines)
    wanted = stored(setjoin.nodes_of(members), "wanted")
    held = sifted(lines.where("items is not null").select("node", "items"), "node", Sieve(rows_of(wanted, "node")))
    held = held.join(wanted, "node", "left_semi").dropDuplicates(["node"])  # each text that a check may need is read here, once
    held = stored(held.mapInArrow(_held, HELD), "held")
    found = setjoin.classes(members, held.select("node", *setjoin.CARRIED), held.select("node", "items"), percent, line_items)
    drop(held)
    labelled = stored(several.join(found, "node", "full").select("node", F.coalesce("component", "node").alias("component")), "labelled")
    place = F.struct("doc_id", "doc_hash", "line")
    at = sifted(lines.select("node", "doc_id", "doc_hash", "line"), "node", Sieve(rows_of(labelled, "node")))
    at = stored(at.join(labelled, "node").select("component", "doc_id", "doc_hash", "line"), "places")
    drop(lines)
    stays = stored(at.groupBy("component").agg(F.min(place).alias("least")), "stays")  # read again, so that a hot component's rows can be split in the join
    gone = at.join(stays, "component").where(~place.eqNullSafe(F.col("least")))
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(F.collect_set("line").alias("__gone"))
    gone = stored(gone, "gone")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("hash"))
    sieve = Sieve(rows_of(gone, "__hash"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)), "n_lines long", "n_removed long"])
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    held = sifted(whole, "hash", sieve).join(gone, same, "left").select("row", "hash", "__gone")
    rest = whole.select("row", "hash").mapInArrow(_removed(kept, text_col, sieve), schema)
    return rest.unionByName(held.mapInArrow(_removed(kept, text_col), schema))
