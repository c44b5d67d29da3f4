"""Whitening against a dense eigendecomposition and exact integers, and Jacobi-Davidson on spectra that are hard to tell apart."""

import math

import numpy as np
import pytest

from citywright.llm import whitening
from citywright.llm.queries import op12_embedding_whitening
from citywright.llm.whitening import jacobi_davidson, whiten


def dense(vectors):
    """(n, {row: exact deviation}, centred doubles, eigenvalues, vectors) from the covariance written out."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    w, q = np.linalg.eigh(y.T @ y / n)
    return n, deviations, y, w[::-1], q[:, ::-1]


def test_equals_a_dense_decomposition(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    odd = [None, [], [1.0] * 11, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [0.0] * 11]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, vectors[0]), (0, vectors[0])] + [(1000 + k, v) for k, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS x", "3 AS ids", "4 AS size")
    frame.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op12_embedding_whitening(spark, str(tmp_path)).collect()
    good = [v for _, v in rows[:302]]
    n, deviations, y, w, q = dense(good)
    assert len(out) == 302 * 8 and {r.n for r in out} == {302} and sum(r.vec_id is None for r in out) == 8 and sum(r.vec_id == 0 for r in out) == 16
    z = y @ q[:, :8] / np.sqrt(w[:8])
    ids = [k for k, _ in rows[:302]]
    got = {(r.vec_id, r.component): r for r in out}
    for c in range(8):
        sign = np.sign(got[(1, c + 1)].whitened * z[1, c])
        for k in range(302):
            r = got[(ids[k], c + 1)]
            assert r.deviation == deviations[k] and abs(r.whitened - sign * z[k, c]) < 1e-10
            assert abs(r.explained / (w[c] / w.sum()) - 1) < 1e-12 and r.identity_error < 1e-12
    assert len({r.identity_error for r in out}) == 1


def test_few_dimensions_equal_rows_and_empty_tables(spark):
    def of(rows):
        return whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()

    assert of([]) == [] and of([("a", None)]) == [] and of([("a", [1.0, 2.0])]) == [] and of([("a", [1.0, 2.0])] * 9) == []
    flat = of([(str(k), [float(k), 2.0 * k, 7.0]) for k in range(20)])
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)
    assert np.mean([r.whitened**2 for r in flat]) == pytest.approx(1, abs=1e-12)
    assert {r.component for r in of([(str(k), [float(k), float(k * k % 7)]) for k in range(20)])} == {1, 2}
    # of two lengths that are as common the greater counts
    assert {r.vec_id for r in of([("a", [1.0]), ("b", [2.0]), ("c", [1.0, 5.0]), ("d", [2.0, 1.0])])} == {"c", "d"}


def test_figures_beyond_a_long(spark):
    rows = [(k, [float(k % 2) * 1e300, 1e15 * k]) for k in range(6)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {None} and all(np.isfinite(r.whitened) for r in out)
    big = [(k, [float(k) * 2**21, 0.0, 1.0]) for k in range(3)]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    x = [1024 * k * 2**21 + 100_000 for k in range(3)]
    want = {k: (3 * x[k] - sum(x)) ** 2 for k in range(3)}
    assert got == {k: v if v < 1 << 63 else None for k, v in want.items()}


def test_partial_products_are_summed_in_tasks_beyond_the_limit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rng.normal(size=(200, 6)).tolist())], "vec_id long, embedding array<double>").repartition(4)
    blocks = whitening.integer_blocks(frame)
    plain = whitening.fit(blocks)
    monkeypatch.setattr(whitening, "MOST_BYTES", 1)
    folded = whitening.fit(blocks)
    assert np.allclose(plain.values, folded.values, rtol=1e-13) and np.allclose(np.abs((plain.vectors * folded.vectors).sum(axis=0)), 1)


@pytest.mark.parametrize("kind", ["clustered", "equal", "steep", "few"])
def test_jacobi_davidson_reaches_double_precision(kind):
    rng = np.random.default_rng(5)
    values = {"clustered": 1 + 1e-3 * rng.random(80), "equal": np.repeat([5.0, 3.0, 1.0], [4, 10, 26]), "steep": 10.0 ** -np.arange(30), "few": np.array([2.0, 1.0, 0.5])}[kind]
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    v = (q * values) @ q.T
    widths = []

    def product(w):
        widths.append(w.shape[1])
        return v @ w

    found, vectors, residuals = jacobi_davidson(product, len(values), 8)
    k = min(8, len(values))
    top = np.sort(values)[::-1]
    assert np.abs(found - top[:k]).max() < 1e-13 * top[0] and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * found, axis=0).max() < 1e-13 * top[0] and residuals.max() < 1e-13 * top[0]
    # no product is wider than the first block, so the operator is never formed
    assert max(widths) <= 16
