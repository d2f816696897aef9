"""Tiled factorisations and distributed eigenpairs against NumPy, with tiles far smaller than the matrices."""

import numpy as np
import pytest

from gridloom.operators import linalg, multilinear, tiled
from gridloom.operators.blocked import Blocked
from gridloom.operators.tensor import Tensor


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(11)


def definite(rng, n: int, complex_: bool = False) -> np.ndarray:
    x = rng.standard_normal((n, n + 3)) + (1j * rng.standard_normal((n, n + 3)) if complex_ else 0)
    return x @ x.conj().T + np.eye(n)


@pytest.fixture(autouse=True)
def no_driver(monkeypatch):
    """Nothing of these sizes may be gathered on the driver."""
    monkeypatch.setattr(linalg, "LIMIT", 4)
    whole = Tensor.to_numpy

    def guarded(self):
        import sys

        assert "gridloom/operators" not in sys._getframe(1).f_code.co_filename, "to_numpy within the library"
        return whole(self)

    monkeypatch.setattr(Tensor, "to_numpy", guarded)


def test_triangles_by_halves(rng):
    for n in (1, 31, 32, 33, 100):
        low = np.tril(rng.standard_normal((n, n))) + 3 * np.eye(n)
        b = rng.standard_normal((n, 5))
        assert np.allclose(low @ tiled.lower_solve(low, b), b) and np.allclose(low.T @ tiled.upper_solve(low.T, b), b)


@pytest.mark.parametrize("n,tile,complex_", [(20, 7, False), (8, 5, True), (5, 64, False)])
def test_cholesky(spark, rng, n, tile, complex_):
    a = definite(rng, n, complex_)
    low = linalg.cholesky(Tensor.from_numpy(spark, a), tile).to_numpy()
    assert np.allclose(low, np.linalg.cholesky(a))


def test_cholesky_fills_tiles_that_were_zero(spark):
    """An arrow: all but the first row and column and the diagonal is zero, the factor is not."""
    n = 8
    a = np.diag(np.full(n, 20.0))
    a[0, :] = a[:, 0] = 1.0
    a[0, 0] = 20.0
    low = linalg.cholesky(Tensor.from_numpy(spark, a, sparse=True), 3).to_numpy()
    assert np.allclose(low, np.linalg.cholesky(a))


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("from_left", [True, False])
@pytest.mark.parametrize("transposed", [True, False])
def test_solve_tri(spark, rng, lower, from_left, transposed):
    m = rng.standard_normal((11, 11)) + 9 * np.eye(11)
    t = np.tril(m) if lower else np.triu(m)
    op = t.T if transposed else t
    b = rng.standard_normal((11, 6) if from_left else (6, 11))
    got = linalg.solve_tri(Tensor.from_numpy(spark, m), Tensor.from_numpy(spark, b), lower, from_left, transposed, tile=6).to_numpy()
    assert np.allclose(op @ got if from_left else got @ op, b)


@pytest.mark.parametrize("complex_", [False, True])
def test_solve_spd(spark, rng, complex_):
    m, b = definite(rng, 10, complex_), rng.standard_normal((7, 10))
    got = linalg.solve_spd(Tensor.from_numpy(spark, m), Tensor.from_numpy(spark, b), tile=6).to_numpy()
    assert np.allclose(got @ m, b)


def test_shapes_must_fit(spark, rng):
    with pytest.raises(ValueError):
        tiled.cholesky(Blocked.from_numpy(spark, rng.standard_normal((4, 5)), 2))
    with pytest.raises(ValueError):
        tiled.solve_tri(Blocked.from_numpy(spark, np.eye(4), 2), Blocked.from_numpy(spark, np.ones((3, 2)), 2))


def test_leading_eigenpairs(spark, rng):
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    d = np.concatenate([[50.0, 49.0, 40.0, 40.0], np.linspace(10, -30, 56)])
    a = (q * d) @ q.T
    values, vectors = tiled.eigenpairs(Blocked.from_numpy(spark, a, 25), 4, 25, tolerance=1e-7)
    x = vectors.to_numpy()
    assert np.allclose(values, d[:4], atol=1e-6) and np.allclose(a @ x, x * values, atol=1e-5) and np.allclose(x.T @ x, np.eye(4), atol=1e-9)


def test_eigenpairs_by_size_and_complex(spark, rng):
    a = definite(rng, 8, True) - 12 * np.eye(8)
    values, vectors = tiled.eigenpairs(Blocked.from_numpy(spark, a, 5), 6, 5, magnitude=True)
    x, every = vectors.to_numpy(), np.linalg.eigvalsh(a)
    assert np.allclose(values, every[np.argsort(-abs(every))][:6]) and np.allclose(a @ x, x * values)


def test_eigenpairs_of_low_rank(spark, rng):
    y = rng.standard_normal((30, 2))
    values, vectors = tiled.eigenpairs(Blocked.from_numpy(spark, y @ y.T, 16), 3, 16)
    x = vectors.to_numpy()
    assert np.allclose(values[:2], np.linalg.eigvalsh(y @ y.T)[:-3:-1]) and np.allclose(values[2:], 0, atol=1e-8) and np.allclose(x.T @ x, np.eye(3), atol=1e-8)


def test_hosvd_keeps_factors_distributed(spark, rng):
    a = rng.standard_normal((3, 4, 3))
    factors, core = multilinear.hosvd(Tensor.from_numpy(spark, a), (3, 4, 3))
    assert all(isinstance(u, Tensor) for u in factors)
    u, v, w = (f.to_numpy() for f in factors)
    assert np.allclose(np.einsum("abc,ia,jb,kc->ijk", core.to_numpy(), u, v, w), a)
