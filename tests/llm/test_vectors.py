"""Search, hard negatives and whitening against plain Python, on a driver table and on odd rows."""

from fractions import Fraction
from math import floor, inf, isfinite, nan

import duckdb
import numpy as np
import pytest

from framewright.llm import hard_negatives, maxscore, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, place long, score string, `a.b` string, x string, rank int"


def odd_rows():
    """Repeated rows and ids, ties, zeros, large and non-finite entries, short and empty vectors, nulls; ids all over."""
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(i, rows[7][1], k % 2) for k, i in enumerate([100, 100, 400, 401, 402, 500])]
    rows += [(600, [0.0] * 6, 1), (601, [0.0] * 6, 2), (700, [1.0, -2.0], 1), (701, [], 0), (800, [], 1), (900, [3e4, -3e4, 1.0, 0.0, 0.0, 2e4], 1), (901, [3e4, -3e4, 1.0, 0.5, 0.0, 2e4], 2)]
    rows += [(None, [1.0] * 6, 1), (50, None, 1), (100, [1.0, None, 0.0], 1), (150, [nan] * 6, 1), (200, [inf, 1.0], 0), (1000, [0.25] * 6, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "s", "d", "x", 2) for r in odd_rows()], SCHEMA).repartition(3)


def usable(rows, scale, shift=0):
    out = [(i, v, k) for i, v, k in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    d = max((len(v) for _, v, _ in out), default=0)
    return [(i, [floor(scale * c) + shift for c in [*v, *[0.0] * (d - len(v))]], k) for i, v, k in out]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_search(rows, every, k):
    rows = [r for r in usable(rows, 256) if r[0] is not None]
    out = []
    for n, (i, v, _) in enumerate(rows):
        if i % every == 0:
            best = sorted((-dot(v, w), j) for m, (j, w, _) in enumerate(rows) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def plain_negatives(rows, every, k):
    rows = [r for r in usable(rows, 256) if r[0] is not None and r[2] is not None]
    out = []
    for n, (i, v, label) in enumerate(rows):
        if i % every:
            continue
        all_ = sorted((-dot(v, w), j, t == label) for m, (j, w, t) in enumerate(rows) if m != n)
        for p, j, _ in [x for x in all_ if x[2]][:k]:
            fit = [(s, m) for s, m, same in all_ if not same and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(fit)]
    return sorted(out)


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]


def test_search(spark, sf_dir, odd):
    for df, k in ((spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5), (odd, 3), (odd, 1000)):
        out = maxscore.top_k(df, 50, k)
        assert sorted(map(tuple, out.collect())) == plain_search(rows_of(df), 50, k)


def test_terms_are_left_out_and_nothing_is_lost():
    """Clustered vectors whose first dimensions carry most of the weight, in many shards: bounds decide, results don't change."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 32)) * 60 / (1 + np.arange(32))).astype(np.int64)
    shards = [vectors.Shard(np.arange(i, i + 500), np.arange(i, i + 500) % 700, np.zeros(500, np.int64), x[i : i + 500]) for i in range(0, 3000, 500)]
    query = vectors.Shard(*(a[::40] for a in (np.arange(3000), np.arange(3000) % 700, np.zeros(3000, np.int64), x)))
    slot, score, id_, place = maxscore.search_cell(query, iter(shards), 5).rows()
    for s in range(len(query.id)):
        want = sorted((-int(x[p] @ query.x[s]), p % 700, p) for p in range(3000) if p != query.place[s])[:5]
        at = np.flatnonzero(slot == s)
        assert [(-int(a), int(b), int(c)) for a, b, c in zip(score[at], id_[at], place[at], strict=True)] == want


def test_numbers_beyond_doubles_are_exact():
    big = np.array([[1 << 30, (1 << 30) + 1], [-(1 << 30), 3]])
    assert vectors.products(big, big.T).tolist() == [[int(a @ b) for b in big.astype(object)] for a in big.astype(object)]


def test_hard_negatives(spark, sf_dir, odd):
    for df, every, k in ((spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, 5), (odd, 10, 3)):
        out = hard_negatives.mine(df, every, k, k)
        assert sorted(map(tuple, out.collect())) == plain_negatives(rows_of(df), every, k)


@pytest.mark.parametrize("n", [1, 64, 65, 1000])
def test_tree_bounds_hold(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-100, 100, (n, 8)) * rng.integers(1, 5, (n, 1))
    s = hard_negatives.with_tree(vectors.Shard(np.arange(n), np.arange(n), np.zeros(n, np.int64), x))
    assert sorted(s.id.tolist()) == list(range(n)) and (x[s.id] == s.x).all()
    query, rows, edges = rng.integers(-90, 90, (20, 8)).astype(float), s.x.astype(float), hard_negatives.edges_of(n)
    base = (query**2).sum(1) + (rows**2).sum(1).max()
    low, high = hard_negatives.leaf_ranges(query, rows, np.frombuffer(s.tree, float).reshape(-1, 5), base)
    d = np.sqrt(np.maximum(base[:, None] - 2 * query @ rows.T, 0))
    assert low.shape[1] == len(edges) - 1 and (np.diff(edges) <= hard_negatives.LEAF).all()
    for k in range(low.shape[1]):
        part = d[:, edges[k] : edges[k + 1]]
        assert (low[:, k] <= part.min(1) + 1e-6).all() and (high[:, k] >= part.max(1) - 1e-6).all()


def test_residues_restore_whole_numbers():
    moduli = whitening.primes(1 << 90)
    assert len(set(moduli)) == len(moduli) and all(p % q for p in moduli for q in range(2, 1024))
    values = np.array([0, 1, -1, (1 << 88) + 12345, -(1 << 89) + 7], object)
    residues = np.array([[int(v % p) for v in values] for p in moduli])
    assert whitening.restored(residues, moduli).tolist() == values.tolist()


def test_scatter_is_exact():
    x = np.random.default_rng(1).integers(-(1 << 40), 1 << 40, (9000, 3))
    moduli = whitening.primes(1 << 100)
    exact = whitening.restored(whitening.residue_sums(x, moduli), moduli)
    big = x.astype(object)
    assert exact[:3].tolist() == (big.T @ big).tolist() and exact[3].tolist() == big.sum(0).tolist()


@pytest.mark.parametrize("far", [0, 1])
def test_whitening(spark, sf_dir, odd, far):
    for df, scale, shift in ((spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64, 10**6 + far * 10**15), (odd, 64, 10**6)):
        rows = usable(rows_of(df), scale, shift)
        n, d = len(rows), len(rows[0][1])
        sums = [sum(r[1][j] for r in rows) for j in range(d)]
        c = [[n * v - s for v, s in zip(r[1], sums, strict=True)] for r in rows]
        centred = np.array([[float(Fraction(v, n)) for v in r] for r in c])
        v = centred.T @ centred / n
        e, vec = np.linalg.eigh(v)
        e, vec = e[::-1], vec[:, ::-1]
        count = min(32, d)
        out = whitening.whiten(df, 32, scale, shift).toPandas()
        assert len(out) == n * count and set(out["n"]) == {n}
        want = sorted((r[0] is None, r[0] or 0, sum(x * x for x in row)) for r, row in zip(rows, c, strict=True))
        got = sorted((i != i, 0 if i != i else int(i), int(x)) for i, x in zip(out["vec_id"][out["component"] == 1], out["deviation"][out["component"] == 1], strict=True))
        assert got == want
        assert out["identity_error"].max() < 1e-6
        share = out.groupby("component")["explained"].first().to_numpy()
        np.testing.assert_allclose(share, e[:count] / np.trace(v), rtol=1e-6)
        # a row's norm in whitened components does not hang on signs; ids repeat in the odd rows
        norms = np.sort((out["whitened"] ** 2).groupby(out.index // count).sum().to_numpy())
        np.testing.assert_allclose(norms, np.sort((((centred @ vec[:, :count]) ** 2) / e[:count]).sum(1)), rtol=1e-6, atol=1e-9)


def test_directions_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).toPandas()
    by = line.groupby("component")
    assert (by["whitened"].apply(lambda w: (w**2).mean()).round(9) == [1.0, 0.0, 0.0]).all() and line["identity_error"].max() < 1e-9
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 2), (None, None, None)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert maxscore.top_k(df, 50).collect() == hard_negatives.mine(df, 100).collect() == whitening.whiten(df).collect() == []


@pytest.mark.parametrize("name", ["op11_maxscore_search", "op12_hard_negatives"])
def test_queries_are_those_of_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLES[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_whitening_query(spark):
    out = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.01")
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert out.count() == 500 * 32
