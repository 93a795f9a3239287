"""Whitening by an exact scatter in residue numbers.

Entries are whole numbers, so their scatter is a whole number too, but one beyond doubles and longs.  Each partition
multiplies residues of its rows modulo several primes, in blocks short enough for doubles to be exact, and adds
them up modulo the primes; the sums over partitions are put together by Chinese remaindering.  Centring, n * G - S * S', is
done in whole numbers before anything is rounded, so the covariance is as exact as doubles can hold, however far
its mean is from zero; its eigenvectors are those of a symmetric matrix of doubles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import batches_of, bounded_batches
from .vectors import matrix, whole_numbers

#: Primes are below 2^PRIME_BITS, so sums of ROWS products of residues stay below 2^53.
PRIME_BITS, ROWS = 20, 1 << 13
COMPONENTS = 32


def primes(above: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as make a product beyond ``above``."""
    out, p, product = [], (1 << PRIME_BITS) - 1, 1
    while product <= above:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def restored(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Whole numbers (objects) from their residues, a row for each modulus, taken from the range around zero."""
    product = reduce(lambda a, b: a * b, moduli, 1)
    assert all(gcd(a, b) == 1 for i, a in enumerate(moduli) for b in moduli[:i])
    total = sum((r.astype(object) * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, moduli, strict=True)), np.zeros(residues.shape[1:], object)) % product
    return np.where(total > product // 2, total - product, total)


def residue_sums(x: np.ndarray, moduli: list[int]) -> np.ndarray:
    """For each modulus, the scatter of the rows and, as a last row, their sum, modulo it."""
    d = x.shape[1]
    out = np.zeros((len(moduli), d + 1, d), np.int64)
    for i, p in enumerate(moduli):
        for first in range(0, len(x), ROWS):
            part = (x[first : first + ROWS] % p).astype(float)
            out[i, :d] = (out[i, :d] + (part.T @ part).astype(np.int64) % p) % p
            out[i, d] = (out[i, d] + part.sum(0).astype(np.int64)) % p
    return out


@dataclass
class Whitening:
    """What the fit found: n, exact sums S, the covariance, eigenvalues in falling order with their vectors as columns, and the trace."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros_like(self.values)

    def scales(self, count: int) -> np.ndarray:
        """One over the root of each eigenvalue; 0 where a direction has no variance beyond rounding."""
        e = self.values[:count]
        flat = e <= len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0) if len(e) else e > 0
        return np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, e)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or objects where these could leave their range."""
        most = self.n * (max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)) + max((abs(s) for s in self.sums.tolist()), default=0)
        return x * self.n - self.sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * self.n - self.sums

    def whiten(self, centred: np.ndarray, count: int) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.vectors[:, :count] * self.scales(count)


def _rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    bounded_batches(vectors.sparkSession)
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))


def _numbers(batch: pa.RecordBatch, d: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole numbers of the usable rows; entries that a shorter vector lacks count as 0."""
    at, values = matrix(batch.column("x"))
    full = np.zeros((len(at), d))
    full[:, : values.shape[1]] = values
    return at, whole_numbers(full, scale, shift)


def fit(vectors: DataFrame, scale: float = 64, shift: int = 1_000_000, vector_col: str = "embedding") -> Whitening | None:
    """Exact sums and scatter of floor(scale * entry) + shift over the rows with a whole vector, and the eigenvectors of their covariance; None of no row."""
    rows = _rows_of(vectors, vector_col, vector_col).select("x")

    def measure(batches):
        n, d, most = 0, 0, 0
        for batch in batches:
            at, values = matrix(batch.column("x"))
            x = whole_numbers(values, scale, shift)
            n, d = n + len(at), max(d, x.shape[1])
            most = max(most, abs(shift), *(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (n, d, most)], names=["n", "d", "most"])

    with batches_of(vectors.sparkSession, ROWS):
        n, d, most = rows.mapInArrow(measure, "n long, d long, most long").agg(F.sum("n"), F.max("d"), F.max("most")).first()
    if not n:
        return None
    moduli = primes(2 * n * max(most * most, most) + 1)

    def add(batches):
        total = np.zeros((len(moduli), d + 1, d), np.int64)
        for batch in batches:
            total += residue_sums(_numbers(batch, d, scale, shift)[1], moduli)
        total %= np.array(moduli)[:, None, None]
        for i in range(len(moduli)):
            at = np.arange((d + 1) * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(total[i].reshape(-1))], names=["prime", "cell", "residue"])

    with batches_of(vectors.sparkSession, ROWS):
        sums = rows.mapInArrow(add, "prime long, cell long, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue")).toArrow()  # d * (d + 1) numbers a prime
    residues = np.zeros((len(moduli), (d + 1) * d), np.int64)
    residues[sums.column("prime").to_numpy(), sums.column("cell").to_numpy()] = sums.column("residue").to_numpy()
    exact = restored(residues % np.array(moduli)[:, None], moduli).reshape(d + 1, d)
    scatter, total = exact[:d], exact[d]
    covariance = np.array([[int(n * scatter[i, j] - total[i] * total[j]) / (n * n) for j in range(d)] for i in range(d)], float).reshape(d, d)
    values, found = np.linalg.eigh(covariance)
    return Whitening(n, total, covariance, np.maximum(values[::-1], 0), found[:, ::-1])


def identity_error(vectors: DataFrame, model: Whitening, count: int, scale: float, shift: int, vector_col: str) -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity, over directions that have variance."""
    rows, d = _rows_of(vectors, vector_col, vector_col).select("x"), len(model.sums)
    count = min(count, d)

    def add(batches):
        total = np.zeros((count + 1, count))
        for batch in batches:
            w = model.whiten(model.centred(_numbers(batch, d, scale, shift)[1]), count)
            total += np.vstack((w.T @ w, w.sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["cell", "v"])

    with batches_of(vectors.sparkSession, ROWS):
        sums = rows.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((count + 1) * count)
    total[sums.column("cell").to_numpy()] = sums.column("v").to_numpy() / model.n
    total = total.reshape(count + 1, count)
    off = np.abs(total[:count] - np.outer(total[count], total[count]) - np.diag(model.scales(count) > 0))
    return float(off.max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row's whitened components, by falling variance from 1.

    Entries c become x = floor(scale * c) + shift (at most 2^62 in size before the shift); the fit is over all rows.  ``deviation`` is
    the sum of (n * x - S)^2, a decimal(38,0); ``whitened`` is x - S / n projected on the component, over the root of its
    variance; ``explained`` is the component's share of the variance; ``identity_error`` is one value for all rows.

    Rows with a null vector or a null or non-finite entry are dropped.  A null id stays a null id, repeated rows count as
    often as they stand.  Shorter vectors count as if they ended in zeros.  A direction without variance (up to rounding) has whitened 0 and isn't
    held against the identity; of one row, or of equal rows, nothing else is left.  There are as many components as
    dimensions if these are fewer.  An empty table gives an empty table; other columns are ignored.
    """
    spark, model = vectors.sparkSession, fit(vectors, scale, shift, vector_col)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], out)
    d, count = len(model.sums), min(components, len(model.sums))
    error = identity_error(vectors, model, count, scale, shift, vector_col)
    share = model.explained[:count]

    def run(batches):
        for batch in batches:
            at, x = _numbers(batch, d, scale, shift)
            if not len(at):
                continue
            c = model.centred(x)
            size = int(max(abs(int(c.min())), abs(int(c.max())))) if c.size else 0
            c2 = c if size * size * max(d, 1) < 1 << 62 else c.astype(object)
            deviation = (c2 * c2).sum(1)
            columns = [
                pa.array(np.repeat(at, count)).cast(pa.int64()),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(at) * count, model.n)),
                pa.array([int(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), count))),
                pa.array(model.whiten(c, count).reshape(-1)),
                pa.array(np.tile(share, len(at))),
                pa.array(np.full(len(at) * count, error)),
            ]
            columns[0] = batch.column("id").take(columns[0])
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in out.split(", ")])

    rows = _rows_of(vectors, id_col, vector_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, out)
