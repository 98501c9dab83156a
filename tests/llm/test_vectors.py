"""Vector compression and whitening: brute force, SQL and odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from kestrel.llm import compression as C
from kestrel.llm import vectors as V
from kestrel.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, x long"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, schema=SCHEMA: spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)


def floats(seed, n, dim, spread=0.3):
    return np.random.default_rng(seed).normal(0, spread, (n, dim)).astype(np.float32).tolist()


def brute_codes(rows):
    """The compression contract with Python integers; rows of (vec_id, embedding, label), usable and in id order."""
    x = [[math.floor(4096 * v) for v in r[1]] for r in rows]
    dim = len(x[0])
    edges = [k * dim // 8 for k in range(9)]
    books = [[v[a:b] for v in x[:16]] for a, b in zip(edges, edges[1:], strict=False)]

    def assign():
        out = []
        for v in x:
            best = [min((sum((p - q) ** 2 for p, q in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(book))
                    for a, b, book in zip(edges, edges[1:], books, strict=False)]
            out.append(([k for _, k in best], sum(d for d, _ in best)))
        return out

    for _ in range(6):
        near = assign()
        for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            for k in range(len(books[part])):
                mine = [v[a:b] for v, (code, _) in zip(x, near, strict=True) if code[part] == k]
                if mine:
                    books[part][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assign()
    labels = {}
    for r, (_, e) in zip(rows, near, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k in code), e, labels[r[2]], sha)
            for r, (code, e) in zip(rows, near, strict=True)]


def codes(df):
    return sorted((tuple(r) for r in C.compressed(df).collect()), key=str)


def test_codes_against_brute_force_over_many_blocks(table, monkeypatch):
    vectors = floats(1, 300, 24)
    rows = [(3 * i, v, i % 4 if i % 5 else None) for i, v in enumerate(vectors)]
    want = sorted(brute_codes(rows), key=str)
    assert codes(table(rows[::-1]).repartition(5)) == want
    assert codes(table(rows).coalesce(1)) == want


def test_codes_equal_their_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({C.OP12_SQL})").fetchall()
    assert sorted(tuple(r) for r in C.op12_compression(spark, SF).collect()) == sorted(want)


def test_codes_of_odd_rows(table):
    good = floats(2, 40, 8)
    odd = [(100, None, 1), (101, [None] + [0.0] * 7, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] * 8, 2),
           (104, [], 1), (105, [0.5] * 7, 1)]
    rows = [(i // 2, v, None) for i, v in enumerate(good)]
    rows = sorted(rows, key=lambda r: (r[0], r[1])) + [(None, [0.25] * 8, 7), (None, [0.25] * 8, 7)]
    assert codes(table(rows + odd)) == sorted(brute_codes(rows), key=str)
    few = [(5, [0.5] * 8, 1), (6, [0.5] * 8, 1)]
    assert codes(table(few)) == [(5, "00" * 8, 0, 0, brute_codes(few)[0][4]), (6, "00" * 8, 0, 0, brute_codes(few)[0][4])]
    assert codes(table(odd[:5])) == [] and codes(table([])) == []
    assert len(codes(table([(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.0] * 8, 0)]))) == 3


def test_uneven_parts_and_repeated_vectors(table):
    rows = [(i, v, 0) for i, v in enumerate(floats(3, 30, 11) + [[0.125] * 11] * 200)]
    assert codes(table(rows)) == sorted(brute_codes(rows), key=str)


def test_blocks_are_bounded_and_lose_no_vector(spark, table, monkeypatch):
    monkeypatch.setattr(V, "block_rows", lambda dim: 7)
    kept, dim = V.usable(table([(i, v, 0) for i, v in enumerate(floats(4, 50, 8))]).coalesce(1), "embedding")
    blocks = C.blocks_of(kept, dim).select("ids").collect()
    assert sorted(i for b in blocks for i in b[0]) == list(range(50)) and max(len(b[0]) for b in blocks) <= 7


# ---- whitening ------------------------------------------------------------------------

def reference(vectors):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = (fit * n - np.array(sums)) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    keep = [i for i in range(min(16, x.shape[1])) if values[i] > 1e-13 * values.sum()]
    white = ((x * n - np.array(sums)) / n) @ turn[:, keep] / np.sqrt(values[keep])
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, white, values[keep] / values.sum()


def check(rows, out):
    n, deviation, white, share = reference([r[1] for r in rows])
    out = out.toPandas().sort_values(["vec_id", "component"])
    k = white.shape[1]
    assert len(out) == len(rows) * k and set(out.n) == {n} and out.identity_error.max() <= 1e-9
    assert out.component.tolist() == list(range(1, k + 1)) * len(rows)
    assert out.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == deviation
    got = out.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8
    assert np.allclose(out.explained.to_numpy().reshape(-1, k)[0], share, rtol=1e-10)


def test_whitening_against_full_decomposition(table):
    v = floats(5, 400, 64) + floats(6, 100, 64, 0.05)
    rows = [(i, x, 0) for i, x in enumerate(v + v[:40])]
    check(rows, W.whitened(table(rows).repartition(6)))


def test_whitening_of_the_given_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = sorted((r["vec_id"], r["embedding"]) for r in t)
    check(rows, W.op13_whitening(spark, SF))


def test_whitening_of_few_dimensions_and_low_rank(table):
    rows = [(i, x, 0) for i, x in enumerate(floats(7, 60, 5))]
    check(rows, W.whitened(table(rows)))
    few = [(i, x, 0) for i, x in enumerate(floats(8, 6, 40))]  # five directions at most
    check(few, W.whitened(table(few)))


def test_whitening_of_odd_rows(table):
    same = [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0), (None, None, 0), (4, [float("nan"), 1.0], 0), (5, [None, 1.0], 0), (6, [], 0)]
    assert W.whitened(table(same)).collect() == [] and W.whitened(table([])).collect() == []
    rows = [(None, [0.0, 0.0], 0), (None, [1.0, 0.0], 0), (7, [0.0, 2.0], 0), (7, [0.0, 2.0], 0), (8, [1.0], 0)]
    out = W.whitened(table(rows)).toPandas()
    assert len(out) == 8 and set(out.n) == {3} and out.vec_id.isna().sum() == 4
    far = W.whitened(table([(i, [s * 3e38, float(i)], 0) for i, s in enumerate((1, -1, 0))])).toPandas()
    assert len(far) and np.isfinite(far.whitened).all()


def test_subspace_iteration_without_gaps():
    """Equal and nearly equal eigenvalues around the last wanted one, and a spectrum over many orders."""
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for values in (np.r_[np.linspace(9, 5, 10), np.full(110, 2.0)], np.r_[10.0 ** -np.arange(12), np.full(108, 1e-13)],
                   np.linspace(2, 1, 120)):
        a = (turn * values) @ turn.T
        got, vectors, residual = W.principal(lambda y, a=a: a @ y, 120, 16)
        assert residual <= W.TOLERANCE * got[0] and np.allclose(got, np.sort(values)[::-1][:16], rtol=0, atol=1e-11 * got[0])
        assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_deviation_beyond_a_long_is_null():
    m = W.Moments(2, [2 * 10**6 + 1, 2 * 10**6], [0, 0])
    x = np.array([[10**6, 10**6 + 3], [10**6 + 2**40, 10**6]], np.int64)
    assert W.deviations(x, m) == [1 + 36, None]
