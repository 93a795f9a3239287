"""Benchmark decontamination by a prefix-filtered containment join.

A window is WINDOW consecutive words of an item (a shorter item is one window).  Its tokens are its
three-word shingles.  A document contains a window only if it contains every token of it, so one token is a
sufficient prefix: the rarest by its places in all documents.  Places of prefix tokens in documents, with the
words around them, are joined to the windows on the token; a match fixes where the window would start, length
and positional bounds drop starts outside the text, and the words of the remaining places are compared.

Windows, tokens and counts are tables; nothing of the benchmark or the documents passes the driver but sieves
of 2 MB.  Documents are read by maps, and only those that hold a window are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, binary_array, chunks, mix, ragged, shingle_hashes, utf8, word_hashes
from .minhash import combined
from .scratch import stored
from .session import bounded_batches
from .sieve import Sieve, rows_of, sifted

WINDOW, TOKEN_WORDS = 10, 3

ANSWER = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]
WINDOWS = "win long, item string, length int, words binary, tokens array<long>"
SPOTS = "hash long, token long, spot long, back int, around binary"


def _tokens(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The token of ``size`` words from each word on, and which of them lie within one text."""
    hashes, inside = shingle_hashes(words, first, size)
    return mix(hashes, 40 + size).view(np.int64), inside


def _chunks(batches):
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for a, b in chunks(off):
            yield batch.slice(a, b - a), *word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM)


def _windows(window: int):
    """WINDOWS rows, one for each window of each item."""

    def run(batches):
        for part, words, first in _chunks(batches):
            many = np.diff(first)
            for length in np.unique(np.minimum(many[many > 0], window)).tolist():
                own = np.flatnonzero(many >= length if length == window else many == length)
                if not len(own):
                    continue
                count = many[own] - length + 1
                start = ragged(first[own], count)
                rows = np.ascontiguousarray(words[start[:, None] + np.arange(length)])
                size = min(TOKEN_WORDS, length)
                tokens = _tokens(words, first, size)[0][start[:, None] + np.arange(length - size + 1)]
                edge = np.arange(len(rows) + 1) * length
                win = mix(combined(rows.T, 60), length).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * tokens.shape[1]).astype(np.int32)), pa.array(tokens.reshape(-1)))
                items = part.column("item").take(pa.array(np.repeat(own, count)))
                yield pa.RecordBatch.from_arrays([pa.array(win), items, pa.array(np.full(len(rows), length, np.int32)), binary_array(rows.reshape(-1), edge), lists], names=[f.split()[0] for f in WINDOWS.split(", ")])

    return run


def _counted(sieve: Sieve, sizes: list[int]):
    """(token, n): in how many places of a chunk each token of the sieve stands."""

    def run(batches):
        for _, words, first in _chunks(batches):
            for size in sizes:
                tokens, inside = _tokens(words, first, size)
                token, n = np.unique(tokens[inside & sieve.keeps(tokens)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

    return run


def _spots(sieve: Sieve, sizes: list[int], window: int):
    """SPOTS rows: places of prefix tokens, with up to ``window`` - 1 words on either side of their first word."""

    def run(batches):
        for part, words, first in _chunks(batches):
            names = part.column("hash")
            for size in sizes:
                tokens, inside = _tokens(words, first, size)
                spots = np.flatnonzero(inside & sieve.keeps(tokens))
                doc = np.searchsorted(first, spots, "right") - 1
                low = np.maximum(spots - window + 1, first[doc])
                high = np.minimum(spots + window, first[doc + 1])
                for a in range(0, len(spots), 1 << 14):
                    s = slice(a, a + (1 << 14))
                    wide = high[s] - low[s]
                    around = binary_array(words[ragged(low[s], wide)], np.append(0, np.cumsum(wide)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(doc[s])), pa.array(tokens[spots[s]]), pa.array(spots[s] - first[doc[s]]), pa.array((spots[s] - low[s]).astype(np.int32)), around], names=[f.split()[0] for f in SPOTS.split(", ")])

    return run


def _answered(kept: list[str], prefix: str, without: Sieve | None):
    """The rows with their answer; ``found`` has what their text holds.  Rows in ``without`` are left out."""

    def run(batches):
        for batch in batches:
            if without:
                batch = batch.filter(pa.array(~without.keeps(batch.column("hash").to_numpy(zero_copy_only=False))))
            for part, words, first in _chunks([batch]):
                cover = np.zeros(len(words) + 1, np.int64)
                items = [(0, None)] * part.num_rows
                for i, x in enumerate(part.column("found").to_pylist() if "found" in part.schema.names else ()):
                    if x:
                        start = np.array([s["start"] for s in x["spans"]]) + first[i]
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + np.array([s["length"] for s in x["spans"]]), -1)
                        items[i] = (x["n_items"], x["sha"])
                upto = np.append(0, np.cumsum(np.cumsum(cover)[:-1] > 0))
                n_hit = upto[first[1:]] - upto[first[:-1]]
                answer = [pa.array(np.diff(first)), pa.array(n_hit), pa.array([n for n, _ in items], pa.int64()), pa.array([s or _NONE for _, s in items], pa.string()), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([*part.column("row").flatten(), *answer], names=[*kept, *(prefix + n for n, _ in ANSWER)])

    return run


#: The SHA-256 of no bytes.
_NONE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (their names after ``prefix``).

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` once A-Z are lowered.  A word inside any occurrence
    of a window is hit; n_items counts the items with such windows, whose ids, sorted as strings and joined by
    commas, are hashed.  Null and empty texts have no words and no hits; items of null id or text, or without
    words, have no window; repeated rows are judged alike; all columns of ``docs`` stay.  A column of ``docs``
    of the same name as a new one is replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in {prefix + a for a, _ in ANSWER}]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    texts = whole.where("text is not null").select("hash", "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)), *(f"`{prefix}{n}` {t}" for n, t in ANSWER)])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = stored(items.mapInArrow(_windows(window), WINDOWS), "windows")
    kinds = windows.groupBy("win", "length").agg(F.min("words").alias("words"), F.min("tokens").alias("tokens"))
    tokens = stored(kinds.select("win", F.posexplode("tokens").alias("place", "token")), "tokens")
    sizes = sorted({min(TOKEN_WORDS, r.length) for r in windows.select("length").distinct().collect()})  # TOKEN_WORDS numbers at most
    known = rows_of(tokens, "token")
    counts = texts.mapInArrow(_counted(Sieve(known), sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")) if sizes else None
    if counts is None:
        return whole.mapInArrow(_answered(kept, prefix, None), schema)
    rarest = tokens.join(counts, "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("p"))
    rarest = stored(rarest.where("p.n > 0").select("win", "p.token", "p.place").join(kinds.select("win", "length", "words"), "win"), "prefixes")
    spots = texts.mapInArrow(_spots(Sieve(rows_of(rarest, "token")), sizes, window), SPOTS)
    fits = (F.col("back") >= F.col("place")) & (F.octet_length("around") >= 8 * (F.col("back") - F.col("place") + F.col("length")))
    same = F.expr("substring(around, 8 * (back - place) + 1, 8 * length) = words")
    hits = stored(spots.join(rarest, "token").where(fits & same).select("hash", (F.col("spot") - F.col("place")).alias("start"), "length", "win").distinct(), "hits")
    spans = hits.groupBy("hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    named = hits.select("hash", "win").distinct().join(windows.select("win", "item").distinct(), "win").groupBy("hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(named, "hash").select("hash", F.struct("spans", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha")).alias("found"))
    found = stored(found, "found")
    sieve = Sieve(rows_of(found, "hash"))
    rest = whole.mapInArrow(_answered(kept, prefix, sieve), schema)
    held = sifted(whole, "hash", sieve).join(found, "hash", "left").mapInArrow(_answered(kept, prefix, None), schema)
    return rest.unionByName(held)
