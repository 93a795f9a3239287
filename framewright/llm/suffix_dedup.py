"""Removal of long repeated byte strings: merged Burrows-Wheeler transforms of the places that can hold one.

A window is LENGTH bytes.  Its anchor is its GRAM bytes of the least hash, the leftmost of equals, so equal
windows have equal anchors at equal places.  Neighbouring windows of one anchor form a range; its body is all
their bytes.  Ranges are counted by (anchor, body): most anchors of a corpus stand once and end here.  All other
bodies, each once and weighted by its places, are dealt out by anchor, and each task merges the transforms of its
bodies (``bwt``): windows whose interval weighs more than one are repeated.

The bodies of a frequent anchor are dealt out as several shards, which are merged in rounds.  A shard passes on one
place of each window, with its weight, so a passage that stands in many bodies shrinks to one in each shard.  These
places meet by a longer part that they share: LENGTH - common bytes of a window lie outside the part known to be
common, so at least half of them on one side of it, and that half joins the part.  After some rounds the part is the
whole window; so no shard ever exceeds its bytes by more than chance, and no pair of windows is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import DEPTH, STRIDE, repeated
from .kernels import U64, binary_array, chunks, prefix_hash, ragged, span_hash, utf8
from .scratch import stored
from .session import bounded_batches

LENGTH, GRAM = STRIDE * DEPTH, 32
#: Bytes that are merged at once, and those read at once.
MERGE_BYTES, READ_BYTES = 1 << 20, 1 << 20
#: Bytes of the longest body: windows that hold one anchor.
BODY = 2 * LENGTH - GRAM

#: Of a body: its places in a document that overlap or touch (here), from the first byte of the first to the last of the last.
RANGES = "doc_id long, doc_hash long, start long, end long, here long, many int, at int, anchor long, body long"


def ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash, body hash and the anchor's place in the body of every range of all texts."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    bits = U64(n.bit_length())
    least, reach, width = ((gram >> bits) << bits) | at.astype(U64), 1, LENGTH - GRAM + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[width - reach : n - LENGTH + 1 + width - reach])
    end = np.repeat(off[1:], np.diff(off))[: n - LENGTH + 1]
    window = np.flatnonzero(end - at[: n - LENGTH + 1] >= LENGTH)
    anchor = (least[window] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(window) else np.zeros(0, np.int64)
    first = window[new]
    many = np.diff(np.append(new, len(window)))
    return first, many, gram[anchor[new]].view(np.int64), span_hash(prefix, first, first + many - 1 + LENGTH, 9).view(np.int64), anchor[new] - first


def _blocks(data: np.ndarray, off: np.ndarray):
    """(first text, bytes, offsets, bytes of the first text that come before): whole texts, or blocks of a long one that share LENGTH - 1 bytes."""
    for a, b in chunks(off, READ_BYTES):
        if b - a > 1 or off[b] - off[a] <= 2 * READ_BYTES:
            yield a, data[off[a] : off[b]], off[a : b + 1] - off[a], 0
            continue
        for s in range(off[a], off[b] - LENGTH + 1, READ_BYTES):
            part = data[s : min(s + READ_BYTES + LENGTH - 1, off[b])]
            yield a, part, np.array([0, len(part)]), s - off[a]


def _ranges(batches):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, part, where, skipped in _blocks(data, off):
            first, many, anchor, body, at = ranges(part, where)
            doc = np.searchsorted(where, first, "right") - 1
            end = first + many - 1 + LENGTH
            order = np.lexsort((first, body))
            new = np.ones(len(order), bool)
            new[1:] = (body[order][1:] != body[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (first[order][1:] > end[order][:-1])
            head = np.flatnonzero(new)
            here = np.diff(np.append(head, len(order)))
            end = end[order[head + here - 1]]
            line = np.argsort(order[head])
            pick, here, end = order[head][line], here[line], end[line]
            names, move = pa.array(a + doc[pick]), skipped - where[doc[pick]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(names), batch.column("doc_hash").take(names), *(pa.array(x) for x in (first[pick] + move, end + move, here, many[pick].astype(np.int32), at[pick].astype(np.int32), anchor[pick], body[pick]))],
                names=[f.split()[0] for f in RANGES.split(", ")],
            )


WANTED = ["anchor", "body", "n", "kinds", "many", "at"]
BODIES = "anchor long, body long, n long, kinds long, many int, at int, bytes binary"


def _bodies(batches):
    """The bytes of the wanted ranges of each document."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        lists = batch.column("wanted")
        wanted = lists.flatten()
        doc = np.repeat(np.arange(len(off) - 1), lists.value_lengths().to_numpy(zero_copy_only=False))
        field = {c: wanted.field(c) for c in (*WANTED, "start")}
        start, many = (field[c].to_numpy(zero_copy_only=False) for c in ("start", "many"))
        size = many.astype(np.int64) - 1 + LENGTH
        for a, b in chunks(np.append(0, np.cumsum(size)), 1 << 23):
            raw = data[ragged(off[doc[a:b]] + start[a:b], size[a:b])]
            yield pa.RecordBatch.from_arrays([*(field[c].slice(a, b - a) for c in WANTED), binary_array(raw, np.append(0, np.cumsum(size[a:b])))], names=[*WANTED, "bytes"])


#: Repeated windows a ... b - 1 of a body; or, with bytes, a piece of the next round: its first window a, key, anchor's place and weight.
MERGED = "anchor long, body long, a long, b long, key long, at long, n long, bytes binary"
DEALT = ["key", "shard", "shards", "anchor", "body", "skip", "at", "n", "bytes"]


def _runs(values: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """String, first and end (past the last) and value of every run of one value, not 0, within a string."""
    edge = np.zeros(len(values) + 1, bool)
    edge[1:-1] = values[1:] != values[:-1]
    edge[where] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    yes = values[start] != 0
    start, end = start[yes], end[yes]
    text = np.searchsorted(where, start, "right") - 1
    return text, start - where[text], end - where[text], values[start]


def _merged(common: int, merge_bytes: int):
    """MERGED from rows DEALT that come sorted by key, shard, body and skip; ``common`` bytes from ``at`` on lie in all windows of a row."""
    half = (LENGTH - common + 1) // 2

    def flush(rows):
        column = dict(zip(DEALT, zip(*rows, strict=True), strict=True))
        anchor, body, skip, at, n, shards = (np.array(column[c], np.int64) for c in ("anchor", "body", "skip", "at", "n", "shards"))
        where = np.append(0, np.cumsum([len(x) for x in column["bytes"]]))
        data = np.frombuffer(b"".join(column["bytes"]), np.uint8)
        times, lead = repeated(data, where, n)
        text, a, b, _ = _runs(times > 1, where)
        none = pa.nulls(len(text), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (anchor[text], body[text], skip[text] + a, skip[text] + b)), none, none, none, pa.nulls(len(text), pa.binary())], names=[f.split()[0] for f in MERGED.split(", ")])
        # of each window of a shard, one place goes on: 1 + whether half of the rest is before the common part + 2 if it weighs more than one
        owner = np.repeat(np.arange(len(rows)), np.diff(where))
        before = at[owner] - (np.arange(len(data)) - where[owner]) >= half
        text, a, b, kind = _runs(np.where(lead & (shards > 1)[owner], 1 + before + 2 * (times > 1), 0), where)
        start, size = where[text] + a, b - a - 1 + LENGTH
        place = at[text] - a - half * ((kind - 1) & 1)
        key = span_hash(prefix_hash(data), start + place, start + place + common + half, 12).view(np.int64)
        for i, j in chunks(np.append(0, np.cumsum(size)), 1 << 22):
            raw = binary_array(data[ragged(start[i:j], size[i:j])], np.append(0, np.cumsum(size[i:j])))
            columns = (anchor[text], body[text], skip[text] + a, skip[text] + b, key, place, 1 + ((kind - 1) >> 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[i:j].astype(np.int64)) for x in columns), raw], names=[f.split()[0] for f in MERGED.split(", ")])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in DEALT), strict=True):
                if rows and row[:2] != rows[-1][:2] and held >= merge_bytes:
                    yield from flush(rows)
                    rows, held = [], 0
                if rows and row[:6] == rows[-1][:6]:  # a repeated row of documents
                    continue
                rows.append(row)
                held += len(row[-1])
        if rows:
            yield from flush(rows)

    return run


def _repeated(bodies: DataFrame, merge_bytes: int) -> DataFrame:
    """(anchor, body, a, b): the repeated windows of all bodies, merged in rounds until each key is one shard."""
    pieces = bodies.select(F.col("anchor").alias("key"), "anchor", "body", F.lit(0).cast("long").alias("skip"), F.col("at").cast("long").alias("at"), "n", "bytes", F.ceil(F.col("kinds") * BODY / merge_bytes).alias("shards"))
    found, common = None, GRAM
    while True:
        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("body", "skip"), "shards")).select(*DEALT)
        dealt = dealt.repartition("key", "shard").sortWithinPartitions("key", "shard", "body", "skip")
        merged = stored(dealt.mapInArrow(_merged(common, merge_bytes), MERGED), "merged")
        windows = merged.where("bytes is null").select("anchor", "body", "a", "b")
        found = windows if found is None else found.unionByName(windows)
        pieces = merged.where("bytes is not null").select("key", "anchor", "body", F.col("a").alias("skip"), "at", "n", "bytes")
        if pieces.isEmpty():
            return found
        common += (LENGTH - common + 1) // 2
        sizes = pieces.groupBy("key").agg(F.ceil(F.sum(F.octet_length("bytes")) / merge_bytes).alias("shards"))
        pieces = pieces.join(sizes, "key")


def _cut(batches):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        spans, kept = [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            merged: list[list[int]] = []
            for s in sorted(found or (), key=lambda s: s["a"]):
                if merged and s["a"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["b"])
                else:
                    merged.append([s["a"], s["b"]])
            raw, at, rest = data[off[i] : off[i + 1]].tobytes(), 0, []
            for a, b in merged:
                rest.append(raw[at:a])
                at = b
            kept.append(b"".join([*rest, raw[at:]]))
            spans.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, removed, kept), one row per input row: the spans removed, and the bytes left.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else, in any document; strings never
    cross documents and overlaps count.  ``removed`` lists maximal spans [start, end) in order.  Null and empty
    texts, and texts of fewer bytes, keep all they have; repeated rows are copies of each other; a character
    may lose some of its bytes, so ``kept`` is binary.  An empty table gives an empty table; other columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc_hash", F.xxhash64("text"))
    found = stored(rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_ranges, RANGES), "ranges")
    counted = stored(found.groupBy("anchor", "body").agg(F.sum("here").alias("n")), "bodies")
    shared = counted.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("anchor", "kinds")
    places = stored(found.join(counted.join(shared, "anchor"), ["anchor", "body"]), "places")
    one = places.groupBy("anchor", "body").agg(F.min(F.struct("doc_id", "doc_hash", "start", "many", "at", "n", "kinds")).alias("p")).select("anchor", "body", "p.*")
    wanted = one.groupBy(F.col("doc_id").alias("id"), F.col("doc_hash").alias("hash")).agg(F.collect_list(F.struct(*WANTED, "start")).alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_hash") == F.col("hash"))
    bodies = rows.join(wanted, same).select("text", "wanted").mapInArrow(_bodies, BODIES)
    windows = _repeated(bodies, merge_bytes)
    # places that overlap are a body that stands more than once, so all its windows are repeated
    spans = places.join(windows, ["anchor", "body"]).select("doc_id", "doc_hash", (F.col("start") + F.col("a")).alias("a"), (F.col("end") - F.col("many") + F.col("b")).alias("b"))
    spans = spans.groupBy(F.col("doc_id").alias("id"), F.col("doc_hash").alias("hash")).agg(F.collect_set(F.struct("a", "b")).alias("found"))
    spans = stored(spans, "spans")
    return rows.join(spans, same, "left").select("doc_id", "text", "found").mapInArrow(_cut, "doc_id long, n_bytes long, removed array<array<long>>, kept binary")
