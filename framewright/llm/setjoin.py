"""From bucket keys to verified links and classes, without all pairs of a bucket.

A bucket is a set of distinct nodes that share a key.  First every member is checked against one centre of its
bucket.  Where a bucket still holds several classes, a centre of its largest class, another one in each bucket, is
checked against the members of the other classes.  What differs in class after that is compared all with all where a
bucket has at most TIMES * SMALL members; beyond SMALL its rows carry wide bitmaps, so that only pairs that may link are
written.  In larger buckets it is joined by prefixes: the items of a set, rarest first, without
those that the sets of a link must share but for one.  Linked sets share an item of
their prefixes, at places that leave enough items after them; sets that share only a frequent passage rarely do.  Wide
bitmaps leave hardly any of these pairs but links, and these are checked.  So each pair of a bucket is verified, or
ruled out exactly by sizes, prefixes and bitmaps, or already lies in one class: no link between classes is lost, and
a bucket of near copies costs about as many checks as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, binary_array, chunks, mix
from .scratch import stored
from .session import batches_of
from .sieve import Sieve, rows_of, sifted

#: Pairs that are compared at once, and the bits that number them.
PAIRS, PAIR_BITS = 1000, 10
#: Words of 64 bits in a set's bitmap, and in that of the last comparison.
WORDS, WIDE = 8, 32
#: Members of the largest bucket whose pairs are compared in one piece, and of the largest one that is compared all with
#: all, in pieces: TIMES * SMALL.
SMALL, TIMES = 512, 8
#: Pairs of a key and a node that a task holds at once.
GATHERED = 1 << 20
#: Cells of the counts by which items are ordered, and those of a row of them.
CELLS, SLOT = 1 << 19, 1 << 12
#: Columns of what a member carries besides its node: the size of its set and its bitmap.
CARRIED = ["n", *(f"m{i}" for i in range(WORDS))]

#: Of a column of stored items: the distinct hashes of all sets, and the first of each (n + 1 values).
Items = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def bitmaps(items: np.ndarray, owner: np.ndarray, sets: int, words: int = WORDS) -> np.ndarray:
    """``words`` rows of 64-bit words, a column for each set: which of 64 * ``words`` cells hold an odd number of its items.

    ``items`` has the distinct hashes of all sets, and ``owner`` the set of each.  A cell in which two bitmaps
    differ has an item that only one of the sets has.
    """
    cells = 64 * words
    at = owner * cells + ((items >> np.uint64(40)) & np.uint64(cells - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=sets * cells) & 1).astype(np.uint8).reshape(sets, cells)
    return np.ascontiguousarray(np.packbits(odd, axis=1, bitorder="little").view(np.int64).T)


def may_link(percent: int, words: int = WORDS) -> Column:
    """Whether sizes and bitmaps of a member and a centre (c_...) allow a link: never false for a pair that is linked.

    The sets differ in d items or more, d being the cells that differ, so of their n + c_n items at most
    (n + c_n - d) / 2 are shared and the union has at least (n + c_n + d) / 2.
    """
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"c_m{i}"))) for i in range(words)))
    return (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")) & ((100 - percent) * (F.col("n") + F.col("c_n")) >= (100 + percent) * differ)


def may_share(percent: int) -> Column:
    """Whether enough items follow the places ``at`` and ``c_at`` of an item, the first that two prefixes share, for a link."""
    after = F.least(F.col("n") - F.col("at"), F.col("c_n") - F.col("c_at"))
    return (100 + percent) * (after + 1) >= percent * (F.col("n") + F.col("c_n"))


def _stars(batches):
    """(key, node, c_node) of rows (key, node) that come in order: every node of a key but its least, c_node."""
    key = head = last = None
    for batch in batches:
        keys, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
        if not len(keys):
            continue
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        other = ~new & np.append(last is None or nodes[0] != last, nodes[1:] != nodes[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        heads = np.where(begin >= 0, nodes[begin], nodes[0] if head is None else head)
        yield pa.RecordBatch.from_arrays([pa.array(keys[other]), pa.array(nodes[other]), pa.array(heads[other])], names=["key", "node", "c_node"])
        key, head, last = keys[-1], heads[-1], nodes[-1]


def _differing(percent: int):
    """(a, b), a < b: the pairs of a key's nodes, of different components, that ``may_link`` allows.

    Rows (key, node, component, n, m0, ...) come in order of their keys, of which none has more than TIMES * SMALL.
    """

    def flush(column):
        node, component, n = (column[c] for c in ("node", "component", "n"))
        words = [column[c].view(np.uint64) for c in column if c[0] == "m"]  # bits of signed numbers would be counted in their absolute values
        step, found = max(1, SMALL * SMALL // (2 * len(node))), []
        for top in range(0, len(node) - 1, step):
            i, j = np.triu_indices(min(step, len(node) - top), 1, len(node) - top)
            i, j = i + top, j + top
            yes = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[yes], j[yes]
            differ = np.zeros(len(i), np.int64)
            for k, word in enumerate(words):
                differ += np.bitwise_count(word[i] ^ word[j])
                if k % 8 == 7 or k == len(words) - 1:
                    yes = (100 - percent) * (n[i] + n[j]) >= (100 + percent) * differ
                    i, j, differ = i[yes], j[yes], differ[yes]
            found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                held = column if held is None else {c: np.concatenate([held[c], column[c]]) for c in column}
            if held is None or not len(held["key"]):
                continue
            cut = np.flatnonzero(np.diff(held["key"])) + 1
            where = [0, *cut.tolist(), *([len(held["key"])] if batch is None else [])]
            found = [flush({c: held[c][x:y] for c in held}) for x, y in zip(where[:-1], where[1:], strict=True) if y - x > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held = {c: held[c][where[-1] :] for c in held}

    return run


def _keyed(batch: pa.RecordBatch) -> np.ndarray:
    """(key, node) of all keys of rows (node, keys); keys are a list, or 64-bit words as bytes, and null has none."""
    keys, node = batch.column("keys"), batch.column("node").to_numpy(zero_copy_only=False)
    if pa.types.is_binary(keys.type):
        many, flat = pc.binary_length(keys).fill_null(0).to_numpy(zero_copy_only=False) // 8, stored_sets(keys.fill_null(b""))[0].view(np.int64)
    else:
        many, flat = pc.list_value_length(keys).fill_null(0).to_numpy(zero_copy_only=False), keys.flatten().to_numpy(zero_copy_only=False)
    return np.stack([flat, np.repeat(node, many)], axis=1)


def _dealt(parts: int):
    """(part, pairs): the (key, node) of rows (node, keys) by part of the keys, GATHERED or a few more at once, as bytes."""

    def run(batches):
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(_keyed(batch))
                n += len(held[-1])
            if n and (batch is None or n >= GATHERED):
                pairs = np.concatenate(held)
                part = (mix(pairs[:, 0].view(U64), 51) % U64(parts)).astype(np.int32)
                order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
                part = part[order]
                first = np.append(0, np.flatnonzero(np.diff(part)) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), binary_array(pairs[order].reshape(-1), 2 * np.append(first, len(part)))], names=["part", "pairs"])
                held, n = [], 0

    return run


def _starred(batches):
    """``_stars`` of rows (part, pairs) that come in order of their parts.

    A part is held whole up to GATHERED pairs; beyond, each of its keys keeps one node, which stays the key's c_node.
    """

    def stars(kept, held):
        pairs = np.concatenate([kept, *held])
        order = np.argsort(pairs[:, 0])
        keys = pairs[order, 0]
        same = keys[1:] == keys[:-1]
        few = order[np.append(False, same) | np.append(same, False)]
        few = few[np.lexsort((pairs[few, 1], few >= len(kept), pairs[few, 0]))]
        if len(few):
            for batch in _stars(iter([pa.RecordBatch.from_arrays([pa.array(pairs[few, 0]), pa.array(pairs[few, 1])], names=["key", "node"])])):
                yield batch.filter(pc.not_equal(batch.column("node"), batch.column("c_node")))

    def heads(kept, held):
        pairs = np.concatenate([kept, *held])
        order = np.lexsort((pairs[:, 1], np.arange(len(pairs)) >= len(kept), pairs[:, 0]))
        return pairs[order[np.append(True, np.diff(pairs[order, 0]) != 0)]]

    none = np.zeros((0, 2), np.int64)
    now, kept, held, n = None, none, [], 0
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        flat, where = stored_sets(batch.column("pairs"))
        cut = np.append(0, np.flatnonzero(np.diff(part)) + 1) if len(part) else []
        for i, j in zip(cut, np.append(cut[1:], len(part)), strict=True):
            if held and part[i] != now:
                yield from stars(kept, held)
                kept, held, n = none, [], 0
            elif n >= GATHERED:
                yield from stars(kept, held)
                kept, held, n = heads(kept, held), [], 0
            kept, now = (kept if part[i] == now else none), part[i]
            held.append(flat[where[i] : where[j]].view(np.int64).reshape(-1, 2))
            n += len(held[-1])
    if held:
        yield from stars(kept, held)


def buckets(keys: DataFrame) -> DataFrame:
    """From (node, keys), where a node may repeat: (key, node, c_node), every node of a bucket but one of them, c_node.

    Keys are dealt out by parts of some 4,096 rows' keys, packed, as most keys are one node's and end here.  A task goes
    through a part at a time, and a bucket of any size takes constant memory.
    """
    spark = keys.sparkSession
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() >> 12)
    with batches_of(spark, 1 << 16):
        each = keys.select("node", "keys").mapInArrow(_dealt(parts), "part int, pairs binary").repartition("part").sortWithinPartitions("part")
        return stored(each.mapInArrow(_starred, "key long, node long, c_node long"), "members")


def stored_sets(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets that were stored as the bytes of their hashes: all hashes, and the first of each set (n + 1 values)."""
    off = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    raw = np.frombuffer(cells.buffers()[2], np.uint8)[off[0] : off[-1]] if cells.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint64), (off - off[0]) // 8


def shared_items(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many hashes the i-th set of ``a`` and of ``b`` share, for PAIRS pairs at most: sorted at once, by pair and 54 bits of hash."""
    n, bits = len(a[1]) - 1, np.uint64(PAIR_BITS)
    high = np.uint64(64) - bits
    both = np.concatenate([(np.repeat(np.arange(n, dtype=np.uint64), np.diff(first)) << high) | (items >> bits) for items, first in (a, b)])
    both.sort()
    return np.bincount((both[1:][both[1:] == both[:-1]] >> high).astype(np.int64), minlength=n)


def jaccard_at_least(percent: int, items: Items = stored_sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the rows (a, b, sa, sb) whose sets have ``100 * intersection >= percent * union``."""

    def check(batches):
        for batch in batches:
            size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sa", "sb"))
            for i, j in ((k, min(k + PAIRS, last)) for first, last in chunks(np.append(0, np.cumsum(size))) for k in range(first, last, PAIRS)):
                rows = batch.slice(i, j - i)
                a, b = items(rows.column("sa")), items(rows.column("sb"))
                shared, both = shared_items(a, b), np.diff(a[1]) + np.diff(b[1])
                yield rows.select(["a", "b"]).filter(pa.array((shared > 0) & (100 * shared >= percent * (both - shared))))

    return check


def parts(batch: pa.RecordBatch, sets: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with stored ``items``, PAIRS rows at most: the rows, their hashes and the first of each row (n + 1 values)."""
    size = pc.binary_length(batch.column("items")).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in chunks(np.append(0, np.cumsum(size))):
        for i in range(first, last, PAIRS):
            part = batch.slice(i, min(PAIRS, last - i))
            yield part, *sets(part.column("items"))


def _cell(items: np.ndarray) -> np.ndarray:
    return (mix(items, 41) % U64(CELLS)).astype(np.int64)


def _cell_counts(sets: Items):
    """(slot, counts): how many items of the sets are in each cell, SLOT cells a row."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, items, _ in parts(batch, sets):
                np.add.at(counts, _cell(items), 1)
        rows = counts.reshape(-1, SLOT)
        full = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([r.tobytes() for r in rows[full]], pa.binary())], names=["slot", "counts"])

    return run


def _counts(counted: DataFrame) -> np.ndarray:
    """The sums of ``_cell_counts``, all cells: CELLS numbers, whatever was counted."""

    def added(table: pa.Table) -> pa.Table:
        out = sum((np.frombuffer(c.as_buffer(), np.int64) for c in table.column("counts")), np.zeros(SLOT, np.int64))
        return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([out.tobytes()], pa.binary())})

    whole = np.zeros((CELLS // SLOT, SLOT), np.int64)
    for row in counted.groupBy("slot").applyInArrow(added, "slot long, counts binary").collect():
        whole[row.slot] = np.frombuffer(row.counts, np.int64)
    return whole.reshape(-1)


class _Verifier:
    """Checks pairs of nodes, and reads the items of a node once.

    ``items_of`` reads (node, items) of the nodes in a table (node), or is a stored table of all of them; ``items`` makes
    sets of a column of them.
    """

    def __init__(self, items_of: Callable[[DataFrame], DataFrame] | DataFrame, items: Items, percent: int):
        self.items_of, self.sets, self.percent = items_of, items, percent
        self.items: DataFrame | None = items_of if isinstance(items_of, DataFrame) else None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The links among different ``pairs`` (a, b), a < b, as edges (u, v), v < u."""
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs.sparkSession.createDataFrame([], "u long, v long")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        self.read(nodes.distinct())
        items = self.thinned(nodes)
        whole = pairs.join(items.select(F.col("node").alias("b"), F.col("items").alias("sb")), "b")
        whole = whole.join(items.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a")
        found = whole.select("a", "b", "sa", "sb").mapInArrow(jaccard_at_least(self.percent, self.sets), "a long, b long")
        return stored(found.select(F.col("b").alias("u"), F.col("a").alias("v")), "links")

    def read(self, wanted: DataFrame) -> None:
        """Have the items of the nodes in ``wanted``."""
        if isinstance(self.items_of, DataFrame):
            return
        if self.items is not None:
            wanted = wanted.join(self.items.select("node"), "node", "left_anti")
        wanted = stored(wanted, "wanted")
        if self.items is not None and wanted.isEmpty():
            return  # no text is read for nothing
        read = stored(self.items_of(wanted), "items")
        self.items = read if self.items is None else self.items.unionByName(read)

    def thinned(self, nodes: DataFrame) -> DataFrame:
        """The items of the nodes in a table (node), which were read, and of few others: what a join shuffles."""
        return sifted(self.items.select("node", "items"), "node", Sieve(rows_of(nodes, "node")))

    def prefixes(self, nodes: DataFrame) -> DataFrame:
        """(key, node, component, at) for nodes (node, component): the items of their prefixes and places, from 1, where items of several nodes have several components.

        Items are in order of the number of sets that have an item of their cell, then of their hashes: any order of all
        items is exact, and this one has frequent items last.  An item alone in its cell is that of one node, so it only
        takes a place.
        """
        if nodes.isEmpty():
            return nodes.sparkSession.createDataFrame([], "key long, node long, component long, at long")
        self.read(nodes.select("node"))
        percent, sets = self.percent, self.sets
        own = stored(self.thinned(nodes).join(nodes, "node"), "own")
        counts = nodes.sparkSession.sparkContext.broadcast(_counts(own.mapInArrow(_cell_counts(sets), "slot long, counts binary")))

        def run(batches):
            for batch in batches:
                for part, items, where in parts(batch, sets):
                    size = np.diff(where)
                    owner, times = np.repeat(np.arange(len(size)), size), counts.value[_cell(items)]
                    order = np.lexsort((items, times, owner))
                    at = np.arange(len(items)) - where[owner] + 1
                    keep = (at <= size[owner] - (percent * size[owner] + 99) // 100 + 1) & (times[order] > 1)
                    of = pa.array(owner[keep])
                    yield pa.RecordBatch.from_arrays([pa.array(items[order][keep].view(np.int64)), part.column("node").take(of), part.column("component").take(of), pa.array(at[keep])], names=["key", "node", "component", "at"])

        return stored(_mixed(stored(own.mapInArrow(run, "key long, node long, component long, at long"), "prefixes")), "mixed")

    def wide(self, nodes: DataFrame) -> DataFrame:
        """(node, n, m0, ...) with WIDE words of the nodes in a table (node)."""
        self.read(nodes)
        sets = self.sets

        def run(batches):
            for batch in batches:
                for part, items, where in parts(batch, sets):
                    size = np.diff(where)
                    words = bitmaps(items, np.repeat(np.arange(len(size)), size), len(size), WIDE)
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(size), *(pa.array(w) for w in words)], names=["node", "n", *(f"m{k}" for k in range(WIDE))])

        return self.thinned(nodes).join(nodes, "node", "left_semi").mapInArrow(run, ", ".join(["node long", "n long", *(f"m{k} long" for k in range(WIDE))]))


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows (key, component, ...) of keys with several components: one sort by key, which spills, and no join."""
    key = Window.partitionBy("key")
    both = labelled.select("*", F.min("component").over(key).alias("__least"), F.max("component").over(key).alias("__most"))
    return both.where("__least < __most").drop("__least", "__most")


def _labelled(live: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (key, node, component) of the buckets that hold several classes; a component is the least neighbour in ``edges``."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return _mixed(live.join(least, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))


def nodes_of(members: DataFrame) -> DataFrame:
    """The distinct nodes of ``buckets``."""
    return members.select("node").unionByName(members.select(F.col("c_node").alias("node"))).distinct()


def classes(members: DataFrame, carried: DataFrame, items_of: Callable[[DataFrame], DataFrame] | DataFrame, percent: int, items: Items = stored_sets) -> DataFrame:
    """(node, component) of every linked node of ``members``, which ``buckets`` made.

    ``carried`` has the size and bitmap of each node's set, (node, n, m0, ...).  Until all links are found, classes
    only save checks, so they are followed no further than that needs; all links are joined to components at the end.
    """
    verifier = _Verifier(items_of, items, percent)
    ordered = [F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")]

    def allowed(pairs: DataFrame) -> DataFrame:
        one = pairs.distinct().join(carried.withColumnRenamed("node", "a"), "a")
        two = one.join(carried.select(F.col("node").alias("b"), *(F.col(c).alias(f"c_{c}") for c in CARRIED)), "b")
        return two.where(may_link(percent)).select("a", "b")

    # every member against the least node of its bucket
    edges = verifier.links(allowed(members.select(*ordered)))

    # the members of other classes against one of the bucket's largest class
    key = Window.partitionBy("key")
    many = F.count("*").over(Window.partitionBy("key", "component"))
    live = _labelled(members.select("key", "node"), edges).select("*", F.struct(many.alias("many"), F.xxhash64("node", "key").alias("draw"), "component", "node").alias("drawn"))
    live = live.select("key", "node", "component", F.max("drawn").over(key).alias("best"))
    live = stored(live.select("key", "node", "component", F.col("best.node").alias("c_node"), F.col("best.component").alias("c_component")), "live")
    more = verifier.links(allowed(live.where("component <> c_component").select(*ordered)))
    found = stored(connected_components(edges.unionByName(more)), "classes")

    # what is left: all with all where a bucket isn't large
    edges = found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    live = _labelled(live.where("node <> c_node").select("key", "node"), edges)
    live = stored(live.select("*", F.count("*").over(key).alias("members")), "live")
    if live.isEmpty():
        return found
    compared = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(_differing(percent), "a long, b long").distinct()
    small = live.where(F.col("members") <= SMALL).join(carried, "node").select("key", "node", "component", *CARRIED)
    near = stored(compared(small), "near")
    wide = stored(verifier.wide(nodes_of(near.select(F.col("a").alias("node"), F.col("b").alias("c_node")))), "wide")
    near = near.join(wide.withColumnRenamed("node", "a"), "a").join(wide.select(F.col("node").alias("b"), *(F.col(c).alias(f"c_{c}") for c in wide.columns if c != "node")), "b")
    near = near.where(may_link(percent, WIDE)).select("a", "b")
    middle = live.where((F.col("members") > SMALL) & (F.col("members") <= TIMES * SMALL))
    if not middle.isEmpty():
        middle = middle.join(verifier.wide(middle.select("node").distinct()), "node").select("key", "node", "component", *wide.columns[1:])
        near = near.unionByName(compared(middle)).distinct()
    more = verifier.links(near)

    # and in large ones by prefixes and wide bitmaps: all sets with an item against those that aren't of its largest class
    large = verifier.prefixes(live.where(F.col("members") > TIMES * SMALL).select("node", "component").distinct())
    if not large.isEmpty():
        top = large.select("*", F.struct(many.alias("many"), "component").alias("held")).withColumn("top", F.max("held").over(key).getField("component")).drop("held")
        left = stored(top.join(verifier.wide(large.select("node").distinct()), "node"), "open")
        other = left.where("component <> top").drop("top")
        other = other.select(*(F.col(c).alias(c if c == "key" else f"c_{c}") for c in other.columns))
        pairs = left.join(other, "key").where("component <> c_component and (component = top or node < c_node)")
        pairs = pairs.where(may_share(percent) & may_link(percent) & may_link(percent, WIDE))  # places and the first words rule out most pairs
        more = more.unionByName(verifier.links(pairs.select(*ordered).distinct()))
    if more.isEmpty():
        return found
    return stored(connected_components(edges.unionByName(more)), "classes")
