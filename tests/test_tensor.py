"""Tensors, index notation and elementwise operators against NumPy."""

import numpy as np
import pytest

from gridloom.functions.algebras import MIN_PLUS
from gridloom.operators import scans
from gridloom.operators.notation import function, function2, transform2
from gridloom.operators.tensor import Tensor, dot, einsum, hstack, kron, outer, tensordot, vstack

RNG = np.random.default_rng(5330)
A, B, C, M = RNG.random((3, 4)), RNG.random((4, 5)), RNG.random((3, 3, 2, 2)), RNG.random((4, 4))
Z = A + 1j * RNG.random((3, 4))


@pytest.fixture
def t(spark):
    return lambda x, sparse=False: Tensor.from_numpy(spark, np.asarray(x), sparse)


def same(got, want):
    got = got.to_numpy() if isinstance(got, Tensor) else np.asarray(got)
    want = np.asarray(want)
    assert got.shape == want.shape
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_contractions(t):
    same(einsum("ij,jk->ik", t(A), t(B)), A @ B)
    same(einsum("aabb->ab", t(C)), np.einsum("aabb->ab", C))
    same(einsum("ij->ijz", t(A), sizes={"z": 2}), np.repeat(A[:, :, None], 2, 2))
    same(einsum("ij,ij->", t(A), t(A)), (A * A).sum())
    same(einsum("ij,Ij->iI", t(A), t(A)), A @ A.T)
    same(dot(t(A), t(B)), A @ B)
    same(outer(t(A[0]), t(B[0])), np.outer(A[0], B[0]))
    same(tensordot(t(C), t(C), ([0, 1], [1, 0])), np.tensordot(C, C, ([0, 1], [1, 0])))
    same(kron(t(A), t(B)), np.kron(A, B))
    same(einsum("ij,jk->ik", t(A), t(B), out=t(A @ B), out_scale=2.0), 3 * A @ B)


def test_ten_operand_network(t):
    m = [RNG.random((8, 8)) for _ in range(10)]
    same(einsum("ab,bc,cd,de,ef,fg,gh,hi,ij,jk->ak", *map(t, m)), np.linalg.multi_dot(m))


def test_subscript_errors(t):
    for notation in ("ij...->ij", "ij,jk->ik", "i->i"):
        with pytest.raises(ValueError):
            einsum(notation, t(A))


def test_arithmetic_broadcasts(t):
    same(t(A) + t(A[0]), A + A[0])
    same(t(A) - 2.0, A - 2.0)
    same(2.0 - t(A), 2 - A)
    same(t(A) * t(A[:, :1]), A * A[:, :1])
    same(t(A) / t(A[0]), A / A[0])
    same(t([1.0, -1.0, 0.0]) / t([0.0, 0.0, 0.0]), [np.inf, -np.inf, np.nan])
    same(t(A) ** 2, A**2)
    with pytest.raises(TypeError):
        x = t(np.arange(3))
        x += 0.5


def test_elementwise(t):
    same(t(A * (A > 0.5)).exp(), np.exp(A * (A > 0.5)))
    same(t([0.5, 1.5, -2.5]).rint(), [1, 2, -3])
    same(t(A * 5).floor(), np.floor(A * 5))
    same(t(A).clip(0.3, 0.7), A.clip(0.3, 0.7))
    same(t(A * 5).astype("int32"), (A * 5).astype("int32"))
    with pytest.raises(TypeError):
        t(A).astype("int32", "safe")


def test_complex(t):
    same(einsum("ij,kj->ik", t(Z), t(Z).conj()), Z @ Z.conj().T)
    same(abs(t(Z)), abs(Z))
    same(t(Z) / t(Z), Z / Z)
    same(t(Z).real(), Z.real)
    same(t(Z).imag(t(A)), Z.real + 1j * A)
    same(t(Z).exp(), np.exp(Z))


def test_comparisons(t):
    same(t(A) <= 0.5, A <= 0.5)
    same(t(np.eye(3), True).equal(t(np.eye(3))), np.ones((3, 3), bool))
    same(t(A) > t(A[0]), A > A[0])
    assert t(A).compare(t(A * (A < 0.9)), 1e-9).count() == (A >= 0.9).sum()


def test_reductions(t):
    same(t(A).sum(axis=0), A.sum(0))
    same(t(A).sum(axis=1, keepdims=True), A.sum(1, keepdims=True))
    same(t(A - 0.5).max(axis=1), (A - 0.5).max(1))
    same(t(np.diag([1.0, 2.0]), True).min(), 0)
    same(t(np.diag([1.0, 2.0]), True).all(axis=0), [False, False])
    same(t(A > 0.9).any(axis=0), (A > 0.9).any(0))
    x = t(A)
    same([x.norm2(), x.norm1(), x.norm(1), x.norm(np.inf), x.norm(2)], [np.linalg.norm(A), abs(A).sum(), np.linalg.norm(A, 1), np.linalg.norm(A, np.inf), np.linalg.norm(A, 2)])
    same(t(B).trace(), np.trace(B))
    same(t(A - 0.5).largest(3), sorted((A - 0.5).ravel(), key=lambda v: -abs(v))[:3])


def test_indexing(t):
    same(t(A)[1:3, ::-2], A[1:3, ::-2])
    same(t(C)[0, ..., 1], C[0, ..., 1])
    x = A.copy()
    x[0:2, 1::2] = 7
    same(t(A).assign((slice(0, 2), slice(1, None, 2)), 7.0), x)
    same(t(A).take([0, -1, 0], 1), A.take([0, -1, 0], 1))
    same(t(A).permute([[2, -1, 0], None]), np.array([A[2], np.zeros(4), A[0]]))
    same(t(A).add_slice((0, 1), (2, 3), t(np.ones((2, 2))), 2.0, 3.0)[:2, 1:3], 2 * A[:2, 1:3] + 3)
    with pytest.raises(ValueError):
        t(A)[[0, 1]]


def test_structure(t):
    same(t(C).transpose([3, 0, 1, 2]), C.transpose(3, 0, 1, 2))
    same(t(C).reshape(9, -1), C.reshape(9, -1))
    same(t(B).diag(1), np.diag(B, 1))
    same(t(B[0]).diag(-1), np.diag(B[0], -1))
    same(t(B).tril(-1), np.tril(B, -1))
    same(t(B).triu(1), np.triu(B, 1))
    same(vstack([t(A), t(A)]), np.vstack([A, A]))
    same(hstack([t(A), t(A)]), np.hstack([A, A]))
    same(t(A).sparsify(0.5), A * (A > 0.5))
    assert t(A).sparsify(0.5).densify().df.count() == A.size


def test_generators(spark):
    same(Tensor.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(Tensor.arange(spark, -5, 5, 0.2), np.arange(-5, 5, 0.2))
    x = Tensor.random(spark, (50, 40), -1, 1, seed=3)
    same(x, x.to_numpy())
    assert -1 <= x.to_numpy().min() < -0.9 < 0.9 < x.to_numpy().max() < 1
    assert 100 < Tensor.random(spark, (50, 40), fraction=0.1).nnz() < 300


def test_points(t):
    same(t(np.zeros((2, 2)), True).write([0, 3, 3], [1.0, 2.0, 3.0]), [[1, 0], [0, 5]])
    same(t(np.ones((2, 2))).write([(0, 1)], [2.0], alpha=3, beta=5), [[1, 11], [1, 1]])
    got = t(np.diag([1.0, 2.0]), True).read([0, 1, 3], [10.0, 10.0, 10.0], alpha=2, beta=1)
    assert sorted(r["v"] for r in got.collect()) == [0.0, 12.0, 14.0]


def test_notation(t):
    b = B[:, :4]
    same(t(b).i("ii").assign(t(b[0]).i("i")), b - np.diag(np.diag(b)) + np.diag(b[0]))
    same(t(A).i("ij").accumulate(t(A).i("ij") * t(A[0]).i("j") * 2 - t(A).i("ij")), 2 * A * A[0])
    same(t(A).i("ij").accumulate(t(A).i("ij"), beta=3), 4 * A)
    same(t(b).i("ii").fill(0.0), b - np.diag(np.diag(b)))
    same(t(b).i("ii").scale(2.0), b + np.diag(np.diag(b)))
    assert abs((t(A).i("ij") * t(A).i("ij")).value() - (A * A).sum()) < 1e-12


def test_functions(t):
    same(function(lambda v: v * v, t(A).i("ij"), "i"), (A * A).sum(1))
    same(function2(lambda a, b: a - b, t(A).i("ij"), t(A[0]).i("j"), "i"), (A - A[0]).sum(1))
    same(transform2(lambda a, b: a * 10 + b, t(A[0]).i("j"), t(A).i("ij")), A[0] * 10 + A)


def test_min_plus(t):
    got = einsum("ij,jk->ik", t(A), t(B), algebra=MIN_PLUS)
    same(got, (A[:, :, None] + B[None]).min(1))


def test_scans(t):
    same(t(A[0]).prefix_sum(), np.cumsum(A[0]) - A[0])
    same(scans.prefix(t(A.ravel()), exclusive=False, block=5), np.cumsum(A.ravel()))
    same(scans.sort(t(A.ravel())), np.sort(A.ravel()))


def test_partitions(t):
    other = t(B).distributed(3, 1)
    got = t(A[:, :3]).align(other)
    assert got.stored.rdd.getNumPartitions() == 3
    held = {}
    for r in got.local().collect():
        held.setdefault(r["i1"], set()).add(r["partition"])
    assert all(len(p) == 1 for p in held.values())
    same(Tensor.from_mapped(t(A).mapped(4, 0), A.shape), A)
    same(vstack(t(A).split(2)), A)
    assert t(A[:2, :2]).print_matrix() == "\n".join(" ".join(map(str, r)) for r in A[:2, :2].tolist())


def test_long_modes_are_repeated_in_steps(spark, monkeypatch):
    from gridloom.plans import planner

    monkeypatch.setattr(planner, "REPEATS", 4)
    for n in (0, 1, 4, 5, 16, 17, 50):
        got = planner.repeated(spark.range(2), "k", n)
        assert sorted((r["id"], r["k"]) for r in got.collect()) == [(i, k) for i in range(2) for k in range(n)]


def test_sums_wait_where_they_do_not_pay(spark):
    """Rows that a label's sum wouldn't merge are summed once, at the end; the result is the same."""
    df = spark.range(200).selectExpr("id % 20 as i0", "id as i1", "id % 3 as i2", "cast(id as double) as v")
    a = Tensor(df, (20, 200, 3), rows=200)
    b = Tensor(spark.range(20).selectExpr("id as i0", "id % 4 as i1", "1.0D as v"), (20, 4), rows=20)
    out = einsum("abc,ad->bd", a, b)
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    same(out, np.einsum("abc,ad->bd", a.to_numpy(), b.to_numpy()))
    same(einsum("abc->b", a), a.to_numpy().sum((0, 2)))
