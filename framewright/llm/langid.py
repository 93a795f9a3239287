"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its letters' vectors,
each permuted (rolled) by its distance from the end; a text's vector bundles (adds) those of its trigrams, and
a language's prototype bundles the texts of that language.  A text's language is the prototype of the largest
cosine, after the prototypes' mean is taken off all vectors.

Prototypes are summed over all training rows on the executors, in integers, so that no order of rows or
partitions changes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, utf8
from .session import as_rows, bounded_batches, whole_rows

SIZE, LETTERS, UNKNOWN = 512, 1024, "und"
_SCALE = 1 << 20
_CHUNK = 1 << 20
#: Rows that are counted at once, and distinct trigrams that are bound at once.
_ROWS, _GRAMS = 500, 2048


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(1729).choice(np.array([-1, 1], np.int8), (LETTERS, SIZE))


def _tables() -> np.ndarray:
    """Of each code point up to the last plane: 0 if it is no letter, else 1 + its lower-case form's place among the letter vectors."""
    out = np.zeros(0x110000, np.int16)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = 1 + ord(c.lower()[0]) % (LETTERS - 1)
    return out


_letters: np.ndarray | None = None
_vectors: np.ndarray | None = None


def letters_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter places of all texts, a 0 before, between and after words, and the first of each text (n + 1 values)."""
    global _letters
    if _letters is None:
        _letters = _tables()
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))[off]  # code points before each text
    n = len(off) - 1
    out = np.zeros(len(codes) + n, np.int16)  # each text starts with a gap
    at = np.arange(len(codes)) + np.repeat(np.arange(1, n + 1), np.diff(upto))
    out[at] = _letters[codes]
    first = upto + np.arange(n + 1)
    gap = out == 0
    again = np.zeros(len(out), bool)
    again[1:] = gap[1:] & gap[:-1]
    again[first[:-1]] = False
    keep = ~again
    return out[keep], np.append(0, np.cumsum(keep))[first]


def text_vectors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector of each text, zero if it has no trigram with a letter, and whether it has a letter."""
    global _vectors
    if _vectors is None:
        _vectors = letter_vectors()
    row, first = letters_of(data, off)
    n = len(off) - 1
    key = np.zeros(0, np.int64)
    wide = np.append(row, np.zeros(2, row.dtype)).astype(np.int64)
    key = (wide[:-2] << 20) | (wide[1:-1] << 10) | wide[2:]
    doc = np.repeat(np.arange(n), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(row))
    inside = (left >= 3) | ((left == 2) & (wide[1:-1] > 0))  # a text ends in a gap as well
    key = np.where(left == 2, key & ~np.int64(1023), key)[inside]
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[inside][order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    place, edge = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key)))), np.append(begin, len(key))
    out = np.zeros((n, SIZE), np.float32)  # sums of whole numbers: exact, so blocks don't show
    for g in range(0, len(begin), _GRAMS):
        grams = key[begin[g : g + _GRAMS]]
        i, j, width = edge[g], edge[min(g + _GRAMS, len(begin))], len(grams)
        bound = (np.roll(_vectors, 2, axis=1)[grams >> 20] * np.roll(_vectors, 1, axis=1)[(grams >> 10) & 1023] * _vectors[grams & 1023]).astype(np.float32)
        counts = np.bincount(doc[i:j] * width + place[i:j] - g, minlength=n * width).reshape(n, width).astype(np.float32)
        out += counts @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    some = np.append(0, np.cumsum(row > 0))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0), some[first[1:]] > some[first[:-1]]


def _limits(off: np.ndarray):
    """Chunks of texts that keep the tables of counts small."""
    for a, b in chunks(off, _CHUNK):
        for i in range(a, b, _ROWS):
            yield i, min(i + _ROWS, b)


@dataclass
class Profiles:
    names: list[str]
    mean: np.ndarray
    unit: np.ndarray


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Prototypes of every language of ``rows``; rows of null language, or without a letter, teach nothing."""
    bounded_batches(rows.sparkSession)

    def summed(batches):
        total: dict[str, list] = {}
        for batch in batches:
            data, off = utf8(batch.column("text"))
            names = np.array(batch.column("lang").to_pylist(), object)
            for a, b in _limits(off):
                vectors, some = text_vectors(data[off[a] : off[b]], off[a : b + 1] - off[a])
                whole = np.rint(vectors * _SCALE).astype(np.int64)
                for name in set(names[a:b].tolist()):
                    mine = (names[a:b] == name) & some
                    seen = total.setdefault(name, [0, np.zeros(SIZE, np.int64)])
                    seen[0] += int(mine.sum())
                    seen[1] += whole[mine].sum(axis=0)
        for name, (n, vector) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * SIZE), pa.array(np.arange(SIZE)), pa.array(vector), pa.array(np.full(SIZE, n))], names=["lang", "place", "total", "n"])

    parts = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = parts.mapInArrow(summed, "lang string, place long, total long, n long").groupBy("lang", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    for r in found.where("n > 0").toLocalIterator():  # SIZE numbers a language
        table.setdefault(r.lang, np.zeros(SIZE))[r.place] = r.total
    names = sorted(table)
    unit = np.array([table[n] / max(np.linalg.norm(table[n]), 1e-12) for n in names]).reshape(len(names), SIZE)
    mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(SIZE)
    unit = unit - mean
    return Profiles(names, mean.astype(np.float32), (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score, half of one plus the cosine.

    Texts that are null or have no letter are ``und`` with score 0, as is every text where nothing was learned;
    of languages with equal cosines the first by name wins; equal texts get equal answers; all columns of
    ``docs`` stay, but for those of the new names.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        known = shared.value
        for batch in whole_rows(batches):
            data, off = utf8(batch.column(text_col))
            for a, b in _limits(off):
                vectors, some = text_vectors(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if known.names:
                    vectors = vectors - known.mean
                    near = (vectors @ known.unit.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                    best = near.argmax(axis=1)
                    score = np.where(some, np.clip((1 + near[np.arange(b - a), best]) / 2, 0, 1), 0.0)
                    names = [known.names[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)]
                else:
                    score, names = np.zeros(b - a), [UNKNOWN] * (b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).select(kept).columns, pa.array(names, pa.string()), pa.array(np.round(score.astype(np.float64), 6))], names=[*kept, "lang_pred", "score"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in kept)]
    return as_rows(docs).mapInArrow(run, ", ".join([*schema, "lang_pred string", "score double"]))
