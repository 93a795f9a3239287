"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first 4 and 5 bytes, each hashed to one of 2**TERM_BITS buckets and
counted once.  score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>): the pairwise part learns what terms
mean together, such as an insult beside the name of a group, which added weights can't.

Fitting is on a bounded sample of labelled rows (SAMPLE_ROWS).  The machine's inputs are the buckets that tell the labels apart
in that sample, by likelihood ratio, and those of all pairs of buckets that tell what a first machine leaves
unexplained, whether or not either tells anything alone.  Scoring is one map over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, U64, chunks, prefix_hash, ragged, span_hash, spans, utf8
from .scratch import stored
from .session import as_rows, bounded_batches, whole_rows

TERM_BITS = 20
#: The fit's bound: at most so many labelled rows, those of the smallest hashes of id and text.
SAMPLE_ROWS = 20_000
_BIN_BITS = 16  # hashes are counted by so many leading bits to find where the sample ends
FACTORS, STEPS, BATCH, RATE, THRESHOLD = 8, 3000, 256, 0.02, 0.7
DECAY_WEIGHTS, DECAY_FACTORS = 1e-5, 1e-5
#: Least likelihood ratio (twice the log) of a chosen term, and least rows it stands in.
LEAST_RATIO, LEAST_ROWS = 14.0, 3
#: Least likelihood ratio of a pair against a machine: so many more pairs are tested than terms.
LEAST_PAIR_RATIO = 36.0
#: Inputs whose pairs are counted together, and pairs that are counted at once.
PAIR_COLUMNS, PAIRS = 32, 1 << 21


@dataclass
class Machine:
    place: np.ndarray  # of each bucket, its input or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, first: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        """Scores of texts from their distinct inputs, listed text by text."""
        n = len(first) - 1

        def sums(x):
            upto = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
            return upto[first[1:]] - upto[first[:-1]]

        v = self.factor[inputs]
        pair = 0.5 * (sums(v) ** 2 - sums(v**2)).sum(axis=1)
        z = self.bias + sums(self.weight[inputs][:, None])[:, 0] + pair if n else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(data: np.ndarray, off: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text (or their inputs, by ``place``): first of each text (n + 1 values), buckets."""
    data = LOWER[data]
    start, end, first = spans(data, off, ALNUM)
    prefix = prefix_hash(data)
    word, found = np.arange(len(start)), []
    for size, seed in ((0, 1), (4, 2), (5, 3)):
        long = np.flatnonzero(end - start > size) if size else word
        stop = start[long] + size if size else end
        bucket = (span_hash(prefix, start[long], stop, seed) >> U64(64 - TERM_BITS)).astype(np.int64)
        if place is not None:
            bucket = place[bucket]
            long, bucket = long[bucket >= 0], bucket[bucket >= 0]
        doc = np.searchsorted(first, long, "right") - 1
        found.append((doc << TERM_BITS) | bucket)
    both = np.unique(np.concatenate(found))
    return np.searchsorted(both >> TERM_BITS, np.arange(len(off))), both & ((1 << TERM_BITS) - 1)


def _chunks(batches):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, b in chunks(off):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]


def _counted(batches):
    """(bucket, label, n): in how many rows of each label each bucket stands."""
    total = np.zeros((2, 1 << TERM_BITS), np.int64)
    for part, data, off in _chunks(batches):
        first, buckets = terms(data, off)
        label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), np.diff(first))
        for k in (0, 1):
            total[k] += np.bincount(buckets[label == k], minlength=1 << TERM_BITS)
    for k in (0, 1):
        some = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), k, np.int64)), pa.array(total[k][some])], names=["bucket", "label", "n"])


def _numbers(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table of numbers without nulls."""
    table = df.toArrow()
    return [table.column(c).to_numpy() for c in table.column_names]


def _chosen(counts: DataFrame, rows: list[int]) -> np.ndarray:
    """The buckets that tell the labels apart, at most as many as there are; ``rows`` are counted by label."""
    by = counts.groupBy("bucket").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0).where(F.col("0") + F.col("1") >= LEAST_ROWS)
    both = F.col("0") + F.col("1")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = F.lit(0.0)
    for k in (0, 1):
        share = rows[k] / sum(rows)
        ratio += part(F.col(str(k)), both * share) + part(rows[k] - F.col(str(k)), (sum(rows) - both) * share)
    return np.sort(_numbers(by.where(2 * ratio >= LEAST_RATIO).select("bucket"))[0].astype(np.int64))


def bounded(keys: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` distinct rows of the smallest hashes.

    Hashes are counted by their leading bits (a fixed number of bins), and only the rows of the bins that the
    sample reaches are sorted, so no task's share grows with the table but by its last bin.
    """
    hashed = keys.withColumn("__order", F.xxhash64(*keys.columns))
    bins = hashed.groupBy(F.shiftrightunsigned("__order", 64 - _BIN_BITS).alias("bin")).agg(F.count("*").alias("n"))
    bin_of, many = _numbers(bins)
    order = np.argsort(bin_of)
    full = np.searchsorted(np.cumsum(many[order]), rows)
    if full < len(order):
        hashed = hashed.where(F.shiftrightunsigned("__order", 64 - _BIN_BITS) <= int(bin_of[order][full]))
    top = F.shiftrightunsigned("__order", 64 - _BIN_BITS)
    return hashed.distinct().orderBy(top, *(F.col(f"`{c}`") for c in hashed.columns)).limit(rows).drop("__order")


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` different labelled rows of ``docs`` (doc_id, text).

    Ids meet ``labels`` (doc_id, label) beside a hash of the text only; the rows picked are a table of bounded
    size, which is broadcast to the texts.  Rows of null id or label are not picked, repeated ones count once.
    """
    ids = docs.select(F.col("doc_id"), F.xxhash64("text").alias("g"))
    picked = stored(bounded(ids.join(labels.where("label is not null").select("doc_id", "label"), "doc_id"), rows), "picked")
    texts = docs.withColumn("g", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "g"])
    return stored(texts.groupBy("doc_id", "g", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "sample")


def _surprise(machine: Machine):
    """(bucket, label, d): of each label's rows, a bound on the likelihood ratio of any pair with the bucket.

    A pair seen in n rows of a label, of expected number e, has the ratio 2 (n log(n / e) - n + e).  By Jensen's
    inequality that is at most the sum of 2 (q - 1 - log q) over these rows, q being the label's probability.
    """

    def run(batches):
        total = np.zeros((2, 1 << TERM_BITS))
        for part, data, off in _chunks(batches):
            score = machine.scores(*terms(data, off, machine.place))
            label = part.column("label").to_numpy(zero_copy_only=False)
            q = np.clip(np.where(label > 0, score, 1 - score), 1e-12, 1)
            first, buckets = terms(data, off)
            row = np.repeat(np.arange(len(q)), np.diff(first))
            for k in (0, 1):
                total[k] += np.bincount(buckets, np.where(label == k, 2 * (q - 1 - np.log(q)), 0)[row], minlength=1 << TERM_BITS)
        for k in (0, 1):
            some = np.flatnonzero(total[k] > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), k, np.int64)), pa.array(total[k][some])], names=["bucket", "label", "d"])

    return run


def _telling_pairs(shared, width: int):
    """(input): those of all pairs with an input of a block (id) that stand in the rows seen more often than expected.

    ``shared`` has first, inputs, the places of the inputs in their order, whether each row is seen, and the
    probability of that.
    """

    def run(batches):
        first, inputs, order, seen, expected = shared.value
        for batch in batches:
            for a in (PAIR_COLUMNS * i for i in batch.column("id").to_pylist()):
                b = min(a + PAIR_COLUMNS, width)
                n, e = np.zeros((b - a) * width), np.zeros((b - a) * width)
                at = order[np.searchsorted(inputs, a, sorter=order) : np.searchsorted(inputs, b, sorter=order)]
                rows = np.searchsorted(first, at, "right") - 1
                size = first[rows + 1] - first[rows]
                for i, j in chunks(np.append(0, np.cumsum(size)), PAIRS):
                    row = np.repeat(rows[i:j], size[i:j])
                    pair = np.repeat((inputs[at[i:j]] - a).astype(np.int64) * width, size[i:j]) + inputs[ragged(first[rows[i:j]], size[i:j])]
                    n += np.bincount(pair[seen[row]], minlength=len(n))
                    e += np.bincount(pair, weights=expected[row], minlength=len(e))
                pair = np.flatnonzero(n > e)
                pair = pair[pair // width + a != pair % width]
                n, e = n[pair], np.maximum(e[pair], 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(pair[2 * (n * np.log(n / e) - n + e) >= LEAST_PAIR_RATIO] % width))], names=["input"])

    return run


def learn(first: np.ndarray, inputs: np.ndarray, label: np.ndarray, width: int, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the logistic loss over minibatches."""
    rng, n = np.random.default_rng(seed), len(label)
    rate = np.clip(label.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(1 + width + width * FACTORS)
    w[0] = np.log(rate / (1 - rate))
    w[1 + width :] = rng.normal(0, 0.05, width * FACTORS)
    m, s, t = np.zeros_like(w), np.zeros_like(w), 0
    decay = np.concatenate(([0.0], np.full(width, DECAY_WEIGHTS), np.full(width * FACTORS, DECAY_FACTORS)))
    for _ in range(-(-STEPS * BATCH // n) if n else 0):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            size = first[rows + 1] - first[rows]
            row, own = np.repeat(np.arange(len(rows)), size), inputs[ragged(first[rows], size)]
            edge = np.append(0, np.cumsum(size))
            v = w[1 + width :].reshape(width, FACTORS)

            def sums(x):
                upto = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
                return upto[edge[1:]] - upto[edge[:-1]]

            xv, squares = sums(v[own]), sums(v[own] ** 2)
            z = w[0] + np.bincount(row, w[1 + own], minlength=len(rows)) + 0.5 * (xv**2 - squares).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / len(rows)
            alone = np.bincount(own, error[row], minlength=width)
            paired = np.stack([np.bincount(own, (error * xv[:, k])[row], minlength=width) for k in range(FACTORS)], axis=1) - alone[:, None] * v
            slope = np.concatenate(([error.sum()], alone, paired.ravel()))
            slope += decay * w
            t += 1
            m, s = 0.9 * m + 0.1 * slope, 0.99 * s + 0.01 * slope**2
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return float(w[0]), w[1 : 1 + width].copy(), w[1 + width :].reshape(width, FACTORS).copy()


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from (doc_id, text, label); rows of null label are ignored, a null text is empty.

    It learns from at most ``sample_rows`` different rows, those of the smallest hashes; repeated rows count once;
    without rows, or with one label only, the machine is its bias.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where("label is not null").select(F.col("text"), (F.col("label") > 0).cast("long").alias("label"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"))
    few = stored(bounded(rows.select("h", "g", "label"), sample_rows), "few")
    same = (rows.h == few.h) & (rows.g == few.g) & (rows.label == few.label)
    sample = stored(rows.join(F.broadcast(few), same, "left_semi").groupBy("h", "g", "label").agg(F.min("text").alias("text")), "sample")
    many = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    per_label = [many.get(0, 0), many.get(1, 0)]
    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism)
    chosen = _chosen(spread.select("text", "label").mapInArrow(_counted, "bucket long, label long, n long"), per_label) if min(per_label) else np.zeros(0, np.int64)
    spread = spread.select("h", "g", "text", "label")

    def rows_of(chosen):
        """The rows of the sample by their inputs among the chosen buckets: place of each bucket, first, inputs, labels."""
        place = np.full(1 << TERM_BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))

        def run(batches):
            for part, data, off in _chunks(batches):
                first, found = terms(data, off, place)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("g"), part.column("label"), lists], names=["h", "g", "label", "inputs"])

        got = spread.mapInArrow(run, "h long, g long, label long, inputs array<int>").orderBy("h", "g").toArrow()  # sample_rows rows at most
        lists = got.column("inputs").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        return place, first, lists.flatten().to_numpy(zero_copy_only=False), got.column("label").to_numpy().astype(float)

    def machine_of(place, first, inputs, label):
        return Machine(place, *learn(first, inputs, label, int(place.max()) + 1))

    alone = rows_of(chosen)
    machine = machine_of(*alone)
    if not min(per_label):
        return machine
    bounds = spread.select("text", "label").mapInArrow(_surprise(machine), "bucket long, label long, d double").groupBy("label", "bucket").agg(F.sum("d").alias("d"))
    of_label, bucket, _ = _numbers(bounds.where(F.col("d") >= LEAST_PAIR_RATIO))  # two for each bucket at most
    more = []
    for k in (0, 1):
        able = np.sort(bucket[of_label == k].astype(np.int64))
        if len(able) > 1:
            _, first, inputs, label = rows_of(able)
            score = machine.scores(*alone[1:3])
            order = np.argsort(inputs, kind="stable").astype(np.int32 if len(inputs) < 1 << 31 else np.int64)
            shared = spread.sparkSession.sparkContext.broadcast((first, inputs, order, label == k, score if k else 1 - score))
            blocks = -(-len(able) // PAIR_COLUMNS)
            found = _numbers(spread.sparkSession.range(0, blocks, 1, -(-blocks // 8)).mapInArrow(_telling_pairs(shared, len(able)), "input long").distinct())[0]
            shared.destroy()
            more.append(able[found.astype(np.int64)])
            del first, inputs, order, label, score, shared
    both = np.unique(np.concatenate([chosen, *more]))
    return machine if len(both) == len(chosen) else machine_of(*rows_of(both))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1 and predicted, 1 where it reaches ``threshold``.

    Null, empty and wordless texts get the score of no terms; equal texts get equal scores, however long; all
    columns of ``docs`` stay, but for those of the new names.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]

    def run(batches):
        machine = shared.value
        for batch in whole_rows(batches):
            data, off = utf8(batch.column(text_col))
            for a, b in chunks(off):
                value = machine.scores(*terms(data[off[a] : off[b]], off[a : b + 1] - off[a], machine.place))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(kept).columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*kept, score_col, predicted_col])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)]
    return as_rows(docs).mapInArrow(run, ", ".join([*schema, f"`{score_col}` double", f"`{predicted_col}` int"]))
