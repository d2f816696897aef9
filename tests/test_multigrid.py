"""Multigrid set up from a matrix, against NumPy."""

import numpy as np
import pytest

from gridloom.operators import multigrid
from gridloom.operators.tensor import Tensor


@pytest.fixture(scope="module")
def grid_matrix(spark):
    """A Poisson problem on an 8 x 8 grid, by the five-point stencil."""
    n = 8
    line = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    return np.kron(line, np.eye(n)) + np.kron(np.eye(n), line)


def test_aggregates_cover_each_vertex_once(spark, grid_matrix):
    strong = multigrid.strength(Tensor.from_numpy(spark, grid_matrix, sparse=True), 0.2)
    assert strong.df.count() == np.count_nonzero(grid_matrix) - len(grid_matrix)
    t = multigrid.aggregates(strong).to_numpy()
    assert np.array_equal(t.sum(axis=1), np.ones(64)) and (t.sum(axis=0) >= 1).all() and 4 <= t.shape[1] <= 24
    # Weak connections don't count: a vertex with no others is by itself.
    alone = multigrid.aggregates(Tensor.zeros(spark, (3, 3))).to_numpy()
    assert np.array_equal(np.sort(alone, axis=0), np.sort(np.eye(3), axis=0))


def test_levels_and_solution(spark, grid_matrix):
    a = Tensor.from_numpy(spark, grid_matrix, sparse=True)
    found = multigrid.Hierarchy.of(a, 26)
    (coarse,) = [x.to_numpy() for x in found.levels[1:]]
    p = found.prolong[0].to_numpy()
    assert np.allclose(coarse, p.T @ grid_matrix @ p) and np.allclose(coarse, coarse.T)
    b = np.random.default_rng(1).standard_normal(64)
    x = found.solve(Tensor.from_numpy(spark, b), 1e-2, 8).to_numpy()
    assert np.linalg.norm(b - grid_matrix @ x) <= 1e-2 * np.linalg.norm(b)


def test_small_and_hopeless(spark):
    one = multigrid.Hierarchy.of(Tensor.from_numpy(spark, np.diag([2.0, 4.0]), sparse=True))
    assert len(one.levels) == 1 and np.allclose(one.solve(Tensor.from_numpy(spark, np.array([2.0, 2.0]))).to_numpy(), [1.0, 0.5])
    with pytest.raises(ArithmeticError):
        one.solve(Tensor.from_numpy(spark, np.array([1.0, 1.0])), tolerance=-1.0, cycles=1)


def test_many_weak_connections_still_make_levels(spark):
    """Each vertex has 30 neighbours or more, none of them strong beside the diagonal: the next level is at most half as large."""
    rng = np.random.default_rng(7)
    w = np.triu(np.where(rng.random((90, 90)) < 0.4, rng.integers(2, 20, (90, 90)), 0), 1).astype(float)
    w = w + w.T
    a = np.diag(w.sum(axis=1) + 1) - w
    matrix = Tensor.from_numpy(spark, a, sparse=True)
    assert multigrid.strength(matrix).df.count() < 90 and multigrid.connected(matrix) < 0.08
    found = multigrid.Hierarchy.of(matrix, 24)
    assert [x.shape[0] for x in found.levels][1:] and found.levels[1].shape[0] <= 45
    b = rng.integers(0, 9, 90).astype(float)
    x = found.solve(Tensor.from_numpy(spark, b), 1e-4, rounds=1).to_numpy()
    assert np.linalg.norm(b - a @ x) <= 1e-4 * np.linalg.norm(b)
