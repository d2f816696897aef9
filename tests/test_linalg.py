"""Linear algebra, multilinear kernels, symmetry and workloads: residuals and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import graphs, linalg, multilinear, symmetry, workloads
from gridloom.operators.profile import Schedule, Timer
from gridloom.operators.tensor import Tensor, einsum
from gridloom.sources import files

RNG = np.random.default_rng(11)
A = RNG.standard_normal((9, 4))
S = A.T @ A + np.eye(4)
T3 = RNG.standard_normal((3, 4, 5)) * (RNG.random((3, 4, 5)) < 0.6)
U = [RNG.standard_normal((n, 2)) for n in T3.shape]


@pytest.fixture
def t(spark):
    return lambda x, sparse=False: Tensor.from_numpy(spark, np.asarray(x), sparse)


def near(got, want, atol=1e-8):
    np.testing.assert_allclose(got.to_numpy() if isinstance(got, Tensor) else got, want, atol=atol)


def test_svd_and_qr(t):
    u, s, vt = linalg.svd(t(A))
    near(u.to_numpy() * s @ vt.to_numpy(), A)
    near(s, np.linalg.svd(A)[1])
    near(u.to_numpy().T @ u.to_numpy(), np.eye(4))
    q, r = linalg.qr(t(A))
    near(q.to_numpy() @ r.to_numpy(), A)
    near(q.to_numpy().T @ q.to_numpy(), np.eye(4))
    near(linalg.gram(t(A)), A.T @ A)
    low = RNG.standard_normal((9, 2)) @ RNG.standard_normal((2, 4))
    for m in (low, np.zeros((5, 3)), A.T, low.T, A + 1j * A[::-1], (low * 1j)[:6], np.eye(4)[:, ::-1]):
        q, r = (x.to_numpy() for x in linalg.qr(t(m)))
        near(q @ r, m)
        near(q.conj().T @ q, np.eye(q.shape[1]))
        near(np.tril(r, -1), 0 * r)
    u, s, vt = linalg.svd(t(A.T), rank=2)
    near(s, np.linalg.svd(A)[1][:2])
    _, s, _ = linalg.svd_rand(t(A), 2, 6)
    near(s, np.linalg.svd(A)[1][:2], 1e-3)


def test_rows_meet_python_in_small_blocks(spark):
    """However many rows a task has, its Python works on a megabyte of them at a time."""
    width = 64
    rows = spark.range(0, 20_000, 1, 2).select(F.col("id").alias("i0"), F.array_repeat(F.lit(0.0), width).alias("row"))

    def longest(*parts):
        """A row that tells the longest block so far; all others are of zeros."""
        most = max(len(parts[-1]), *(p.max() for p in parts if p is not None))
        return np.full((1, width), float(most))

    assert linalg._reduced(rows, longest, False).max() <= (1 << 20) // (8 * width) + 1


def test_blocks_of_rows(t):
    """Rows and their ids stay together over blocks, batches of few rows and tasks of fewer rows than columns."""
    x = RNG.standard_normal((5000, 70))
    z = x[:, :35] + 1j * x[:, 35:]
    for m in (x, z):
        near(linalg.product(t(m), t(m[:40].T)), m @ m[:40].T)
        near(linalg.gram(t(m)), m.conj().T @ m)
        # Four tasks of 20 rows or so, of 70 or 35 columns.
        for a in (m, m[:80]):
            q, r = (y.to_numpy() for y in linalg.qr(t(a)))
            near(q @ r, a)
            near(q.conj().T @ q, np.eye(a.shape[1]))


def test_factorisations(t):
    low = linalg.cholesky(t(S))
    near(low, np.linalg.cholesky(S))
    near(linalg.solve_tri(low, t(A.T)), np.linalg.solve(np.linalg.cholesky(S), A.T))
    near(linalg.solve_tri(low, t(A), from_left=False).to_numpy() @ low.to_numpy(), A)
    near(linalg.solve_spd(t(S), t(A)).to_numpy() @ S, A)
    d, v = linalg.eigh(t(S))
    near(S @ v.to_numpy(), v.to_numpy() * d)
    z = np.linalg.cholesky(S) * (1 + 0.5j)
    near(linalg.solve_tri(t(z), t(A.T)), np.linalg.solve(z, A.T))
    u, s, v = linalg.svd_batch(t(T3))
    near(np.einsum("bik,bk,bkj->bij", u.to_numpy(), s.to_numpy(), v.to_numpy()), T3)


def test_multilinear(t):
    x = t(T3, True)
    near(multilinear.tttp(x, U), T3 * np.einsum("ir,jr,kr->ijk", *U))
    near(multilinear.mttkrp(x, U, 1), np.einsum("ijk,ir,kr->jr", T3, U[0], U[2]))
    rhs = RNG.standard_normal((3, 2))
    got = multilinear.solve_factor(x.map(lambda v: F.abs(v)), U, t(rhs), 0).to_numpy()
    for i in range(3):
        g = np.einsum("jk,jr,kr,js,ks->rs", abs(T3[i]), U[1], U[2], U[1], U[2])
        near(g @ got[i], rhs[i])
    factors, core = multilinear.hosvd(t(T3), T3.shape)
    near(np.einsum("abc,ia,jb,kc->ijk", core.to_numpy(), *(u.to_numpy() for u in factors)), T3)
    u, s, v = t(T3).i("ijk").svd("ia", "ajk")
    near(np.einsum("ia,a,ajk->ijk", u.to_numpy(), s, v.to_numpy()), T3)
    full = np.einsum("ir,jr,kr->ijk", *U)
    # Alternating least squares never lets the residual grow; how fast it falls depends on the start.
    left = [np.linalg.norm(np.einsum("ir,jr,kr->ijk", *multilinear.als(t(full), 2, n)) - full) for n in (1, 3)]
    assert left[1] < left[0] < np.linalg.norm(full)


def test_completion_by_numpy(t):
    """Each round against least squares row by row; a low-rank tensor is found again at places left out; a row without entries is zero."""
    n, rank = (6, 5, 4), 2
    truth = [RNG.uniform(0.5, 1.5, (k, rank)) for k in n]
    full = np.einsum("ir,jr,kr->ijk", *truth)
    known = RNG.random(n) < 0.8
    known[5] = False
    a = t(np.where(known, full, 0)).sparsify(0.0)
    start = [RNG.uniform(0.1, 1, (k, rank)) for k in n]
    got = [f.to_numpy() for f in multilinear.completion(a, rank, 2, 0.1, [None, *(t(f) for f in start[1:])])]
    want = [f.copy() for f in start]
    for _ in range(2):
        for mode in range(3):
            rows = np.zeros((n[mode], rank))
            for i in range(n[mode]):
                at = [p for p in np.argwhere(known) if p[mode] == i]
                u = np.array([np.prod([want[k][p[k]] for k in range(3) if k != mode], axis=0) for p in at]).reshape(-1, rank)
                rows[i] = np.linalg.solve(u.T @ u + 0.1 * np.eye(rank), u.T @ np.array([full[tuple(p)] for p in at]))
            want[mode] = rows
    for x, y in zip(got, want):
        near(x, y)
    assert not got[0][5].any()
    found = multilinear.completion(a, rank, 8, 1e-9, [None, *(t(f) for f in start[1:])], tolerance=1e-3)
    off = np.einsum("ir,jr,kr->ijk", *(f.to_numpy() for f in found))[:5] - full[:5]
    assert np.abs(off[~known[:5]]).max() < 0.3
    assert abs(multilinear.squared_error(a, found) - (off[known[:5]] ** 2).sum()) < 1e-6


def test_symmetry(t):
    m = RNG.standard_normal((4, 4))
    for kind, whole in (("SY", m + m.T - np.diag(np.diag(m))), ("AS", m - m.T), ("SH", m + m.T - 2 * np.diag(np.diag(m)))):
        packed = symmetry.symmetrize(t(m), kind)
        near(symmetry.desymmetrize(packed), whole)
        assert packed.stored.count() == symmetry.packed_size(4, kind)
        # A packed tensor is what it stands for wherever it goes.
        near(einsum("ij,j->i", packed, t(np.ones(4))), whole.sum(1))
        near([packed.norm2(), float(packed.sum())], [np.linalg.norm(whole), whole.sum()])
        near(packed * 2.0 + packed.T, 2 * whole + whole.T)
        near(symmetry.recast(packed, "SH"), whole - np.diag(np.diag(whole)) if kind != "AS" else np.triu(whole, 1) - np.triu(whole, 1).T * -1)
    near(symmetry.aligned(t([[0.0, 1], [5, 0]]), "AS"), [[0, -4], [4, 0]])
    s = m + m.T
    near(symmetry.product(t(s), t(s)), 2 * s @ s)
    near(symmetry.scale_diagonal(t(m), 0), m - np.diag(np.diag(m)))


def test_graphs(spark, t):
    w = np.array([[0, 4, 1, 0], [0, 0, 0, 1], [0, 2, 0, 5], [0, 0, 0, 0.0]])
    a = t(w, True)
    d, negative = graphs.shortest_paths(a, 0)
    assert not negative and [d.to_numpy()[i] for i in range(4)] == [0, 3, 1, 4]
    assert graphs.shortest_paths(t([[0, -1.0], [-1.0, 0]], True), 0)[1]
    near(graphs.all_shortest_paths(a).to_numpy()[0], [0, 3, 1, 4])
    hops = {(r["i0"], r["i1"]): (r["w"], r["h"]) for r in graphs.path_hops(a.df, 2).collect()}
    assert hops[0, 3] == (4.0, 3)
    # A path of five: the middle one carries most.
    p = np.diag(np.ones(4), 1)
    near(graphs.betweenness(t(p + p.T, True)).to_numpy(), [0, 6, 8, 6, 0])
    ring = np.roll(np.eye(8), 1, 1)
    for distance in (1, 2):
        chosen = np.flatnonzero(graphs.independent_set(t(ring, True), distance).to_numpy())
        gaps = np.diff([*chosen, chosen[0] + 8])
        assert gaps.min() > distance and gaps.max() <= 2 * distance + 1
    counts = {r["i"]: (r["w"], r["m"]) for r in graphs.path_counts(t([[0, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0.0]], True).df, 0, 3).collect()}
    assert counts[3] == (2.0, 2)


def test_workloads(spark, t):
    m = np.diag([4.0] * 4) + RNG.random((4, 4)) * 0.5
    b = RNG.random(4)
    near(workloads.jacobi(t(m), t(b)), np.linalg.solve(m, b), 1e-6)
    x = RNG.random((4, 2))
    near(workloads.dft(t(x)), np.fft.fftn(x))
    near(workloads.fft(t(b)), np.fft.fft(b))
    near(workloads.bitonic_sort(t(b)), np.sort(b))
    c = RNG.random(64)
    near(workloads.bitonic_sort(t(c), block=8), np.sort(c))
    near(workloads.fft_split(t(c), 16), np.fft.fft(c))
    y, z = RNG.random((8, 8)), RNG.random((8, 8))
    near(workloads.strassen(t(y), t(z), 4), y @ z)
    near(workloads.recursive_product(t(y[:, :6]), t(z[:6]), 4), y[:, :6] @ z[:6])
    with pytest.raises(ArithmeticError):
        workloads.jacobi(t([[1.0, 2.0], [2.0, 1.0]]), t([1.0, 1.0]), rounds=3)
    k = np.array([1.0, 2.0])
    near(workloads.convolve(t(b), t(k)), [b[i] + 2 * b[i - 1] for i in range(4)])
    h = np.array([[1, 1], [1, -1]]) / np.sqrt(2)
    near(workloads.circuit(t([[1.0, 0], [0, 0]]), [(t(h), (0,)), (t(h), (1,))]), np.full((2, 2), 0.5))
    a1 = workloads.poisson(spark, 7)
    p = np.zeros((7, 3))
    for j in range(3):
        p[2 * j : 2 * j + 3, j] = [0.5, 1, 0.5]
    pt = t(p, True)
    rhs = np.ones(7)
    y = workloads.v_cycle([a1, workloads.galerkin(a1, pt)], [pt], t(rhs), t(np.zeros(7)))
    assert np.linalg.norm(a1.to_numpy() @ y.to_numpy() - rhs) < 0.3 * np.linalg.norm(rhs)
    near(workloads.interactions(t(b), lambda i, j: i - j), 4 * b - b.sum())


def test_files(spark, t, tmp_path):
    x = t(T3, True)
    files.write_text(x, f"{tmp_path}/coo")
    near(files.read_text(spark, f"{tmp_path}/coo", T3.shape), T3)
    files.write_parquet(x, f"{tmp_path}/pq")
    near(files.read_parquet(spark, f"{tmp_path}/pq", T3.shape), T3)
    files.write_binary(x, f"file://{tmp_path}/dense", block=7)
    near(files.read_binary(spark, f"file://{tmp_path}/dense", T3.shape), T3)
    near(np.frombuffer(b"".join(f.read_bytes() for f in sorted((tmp_path / "dense").glob("*.bin")))), T3.ravel())
    z = T3 + 1j
    files.write_binary(t(z), f"file://{tmp_path}/complex")
    near(files.read_binary(spark, f"file://{tmp_path}/complex", z.shape, "complex128"), z)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "0").write_bytes(T3.ravel()[:25].tobytes())
    (tmp_path / "raw" / "1").write_bytes(T3.ravel()[25:].tobytes())
    near(files.read_binary(spark, f"{tmp_path}/raw", T3.shape), T3)


def test_stream(spark, tmp_path):
    from gridloom.streaming.upserts import StreamedTensor

    spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "i0 long, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i0 long, v double").parquet(f"{tmp_path}/in")
    target = StreamedTensor(spark, f"{tmp_path}/out", 1)
    target.start(stream, f"{tmp_path}/cp").awaitTermination()
    assert {r["i0"]: r["v"] for r in target.read().collect()} == {0: 4.0, 1: 2.0}


def test_schedule():
    seen = []
    s = Schedule()
    s.record(lambda: seen.append("a"), writes=("x",))
    s.record(lambda: seen.append("b"), reads=("x",), writes=("y",))
    s.record(lambda: seen.append("c"), reads=("y",))
    with Timer("run"):
        s.execute()
    assert seen == ["a", "b", "c"] and Timer.totals["run"][1] == 1


def test_block_product(spark):
    a = spark.createDataFrame([(0, 0, 1, 2, [1.0, 2.0]), (0, 1, 1, 1, [3.0])], "i int, j int, rows int, columns int, values array<double>")
    b = spark.createDataFrame([(0, 0, 2, 1, [1.0, 1.0]), (1, 0, 1, 1, [10.0])], "i int, j int, rows int, columns int, values array<double>")
    assert [r["values"] for r in workloads.block_product(a, b, 2).collect()] == [[33.0]]


def test_einsum_types(t):
    assert einsum("i,i->", t(np.arange(3)), t(np.arange(3))).dtype == "int64"


def test_large_products_are_pairs_of_blocks(spark, t, monkeypatch):
    """Beyond what the driver takes: no shuffle and no join of entries, only a Cartesian product of blocks."""
    for name, value in (("LIMIT", 8), ("ROWS", 256), ("PLACES", 20), ("PARTS", 3)):
        monkeypatch.setattr(linalg, name, value)
    x, y = RNG.standard_normal((37, 5)), RNG.standard_normal((5, 29))
    got = linalg.product(t(x), t(y))
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Aggregate" not in plan
    near(got, x @ y)
    assert got.df.count() == 37 * 29
