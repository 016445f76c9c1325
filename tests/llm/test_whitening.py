import math

import numpy as np
import pytest

from skein.functions.shared import table
from skein.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """(whole numbers, deviations, eigenvalues and vectors of their covariance) by the definition."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, [sum(int(v) ** 2 for v in row) for row in n * x - s], values[::-1], axes[:, ::-1]


def test_query_against_the_covariance(spark):
    rows = whitening.op12_whiten(spark, SF).collect()
    table_rows = [r for r in table(spark, SF, "embeddings").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x, n, s, deviation, values, axes = plain([r.embedding for r in table_rows])
    k = min(16, x.shape[1])
    assert len(rows) == k * len(table_rows)
    at = {r.vec_id: i for i, r in enumerate(table_rows)}
    got = np.zeros((len(table_rows), k))
    for r in rows:
        i = at[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[i]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    want = (n * x - s) / n @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-7)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def test_ill_conditioned_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 6)) * np.array([1e9, 1e6, 1e3, 1, 0.5, 0.1])
    vectors = (base @ np.linalg.qr(rng.normal(size=(6, 6)))[0]).tolist()
    model = whitening.fit_whitening(frame(spark, vectors).repartition(5))
    x = np.floor(np.array(vectors) * 64)
    sizes = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert model.basis.shape == (6, 6) and model.identity_error < 1e-4
    assert np.allclose(model.explained, sizes**2 / (sizes**2).sum(), rtol=1e-6)


def test_directions_without_differences_are_no_components(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 2))
    vectors = np.column_stack([a, a[:, 0], np.full(200, 3.0), np.zeros(200)]).tolist()
    model = whitening.fit_whitening(frame(spark, vectors))
    assert model.basis.shape == (5, 2) and model.identity_error < 1e-9 and abs(sum(model.explained) - 1) < 1e-12


def test_copies_have_no_weight(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(50, 4)).tolist()
    one = whitening.fit_whitening(frame(spark, vectors))
    more = whitening.fit_whitening(frame(spark, vectors + [vectors[0]] * 500))
    assert one.n == more.n == 50 and one.sums == more.sums and np.allclose(np.abs(one.basis), np.abs(more.basis), rtol=1e-9)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (2, [3.0, -1.0], 7), (3, None, 7), (4, [None, 1.0], 7), (5, [nan, 1.0], 7), (6, [inf, 1.0], 7), (7, [], 7), (8, [1.0], 7), (9, [2.5, 9.0], 7), (None, [0.0, -0.5], 7)],
        "vec_id long, embedding array<double>, deviation int",
    )
    model = whitening.fit_whitening(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"] and model.n == 4
    assert sorted((r.vec_id is None, r.vec_id) for r in out.collect() if r.vec_id) == [(False, 1), (False, 1), (False, 2), (False, 9)] and out.count() == 5
    assert whitening.fit_whitening(df.limit(0)) is None and whitening.fit_whitening(df.where("vec_id = 1")) is None
    assert whitening.whiten(df.limit(0), model).count() == 0


def test_whole_numbers_beyond_64_bits():
    x = np.array([[2**61, 1], [-(2**61), 3]])
    d = whitening.numerators(x, 5, [0, 4])
    assert d.tolist() == [[5 * 2**61, 1], [-5 * 2**61, 11]]
    assert whitening.deviations(d) == [None, None]
    assert whitening.deviations(np.array([[3_000_000_000, 0]])) == [9 * 10**18]


def test_query_of_an_empty_table(spark, tmp_path):
    frame(spark, [[1.0]]).limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op12_whiten(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


@pytest.mark.parametrize("size", [1, 3, 40])
def test_triangular_solves(size):
    rng = np.random.default_rng(size)
    r = [np.triu(rng.normal(size=(size, size))) + 3 * np.eye(size) for _ in range(2)]
    rows = rng.normal(size=(7, size))
    assert np.allclose(whitening.solve(rows, r) @ r[1] @ r[0], rows)
