"""Whitening against whole-number arithmetic and a library's eigenvectors, and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cuesmith.llm import whitening

KIND = "vec_id long, embedding array<float>"


def plain(vectors):
    """id -> component -> values, by plain arithmetic; component signs as numpy gives them."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    once = sorted({tuple(v) for _, v in x})
    n, d = len(once), len(once[0])
    sums = [sum(v[k] for v in once) for k in range(d)]
    mean = np.array([s / n for s in sums])
    y = np.array(once, float) - mean
    values, own = np.linalg.eigh(y.T @ y / n)
    values, own = values[::-1], own[:, ::-1].T
    out = {}
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        out[i] = [(n, deviation, float((np.array(v) - mean) @ own[k]) / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(4, d))]
    return out


def check(spark, vectors):
    want = plain(vectors)
    got = whitening.whiten(spark.createDataFrame(vectors, KIND)).collect()
    signs = {}
    assert len(got) == sum(len(want[i]) for i, _ in vectors)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        if abs(whitened) > 1e-3:
            assert signs.setdefault(r["component"], r["whitened"] * whitened > 0) == (r["whitened"] * whitened > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(whitened), rel=1e-6, abs=1e-9)
        assert r["identity_error"] < 1e-9


def test_against_plain_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((300, 12)) * np.linspace(0.2, 3, 12)).tolist())]
    check(spark, rows + [(1000 + i, v) for i, v in rows[:40]] + [(2000 + i, [c + 1e-6 for c in rows[0][1]]) for i in range(200)])


def test_the_given_table(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, vectors)


def test_few_dimensions_and_repeated_ids(spark):
    check(spark, [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (3, [-0.25, 0.125]), (4, [7.0, 2.0]), (4, [7.0, 2.0])])


def test_small_eigenvalues_are_accurate():
    scale = np.diag([1.0, 1e-3, 1e-7])
    like = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    values, own = whitening.jacobi(scale @ like @ scale)
    exact = math.exp(math.log(np.linalg.det(like)) + 2 * math.log(1e-10))
    assert values.prod() == pytest.approx(exact, rel=1e-13)
    assert np.allclose(own @ own.T, np.eye(3), atol=1e-15)


def test_jacobi_against_a_library():
    rng = np.random.default_rng(2)
    for d in (1, 2, 9, 40):
        a = rng.standard_normal((d, d))
        a = a @ a.T
        values, own = whitening.jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-10)
        assert np.allclose(own @ a @ own.T, np.diag(values), atol=1e-9 * values[0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (None, [0.5, 0.5]), (6, [0.0, -0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    out = whitening.whiten(spark.createDataFrame([(*r, 0.0, 1) for r in rows], KIND + ", x double, component int")).collect()
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert set(got) == {(i, k) for i in (None, 6, 7) for k in (1, 2)} | {(i, k) for i in (8, 9) for k in (1, 2, 3)}
    assert all(got[i, k]["whitened"] is None and got[i, k]["explained"] is None and got[i, k]["n"] == 1 and got[i, k]["deviation"] == 0 for i in (8, 9) for k in (1, 2, 3))
    assert got[None, 1]["n"] == 3 and got[None, 1]["identity_error"] < 1e-12
    none = whitening.whiten(spark.createDataFrame([], KIND))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_line_has_one_component_and_large_entries(spark):
    out = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 3e38]) for i in range(5)], KIND)).collect()
    by = {(r["vec_id"], r["component"]): r for r in out}
    assert by[0, 1]["explained"] == pytest.approx(1) and by[0, 1]["whitened"] is not None
    assert by[0, 2]["whitened"] is None and by[0, 3]["whitened"] is None
    whole = whitening.Fit(3, [3 * 10**9, 0], 10**9, np.array([10**9, 0], object), np.zeros(2))
    assert whole.deviation(np.array([[10**9, 5], [10**9 + 7, 1], [-(10**9), 0]])) == [225, 450, None]
