"""Dense linear algebra on tensors.

Tall matrices stay distributed: rows as arrays (of a complex matrix the real parts, then the imaginary ones), Gram
matrices by outer products summed in tasks, QR by a tree of small factorisations. What must be factored as a whole is as
wide as the shorter side; that side's square is bounded by LIMIT and is worked on by the driver. Batches are factored
slice by slice in tasks. Square matrices of any size are factored, solved and searched for leading eigenpairs in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..sources.checkpoint import checkpointed
from . import blocked, tiled
from .tensor import V, Tensor, einsum

#: Longest short side that the driver factors.
LIMIT = 4096
#: Bytes of rows that a task's Python works on at a time, however many rows Spark hands on.
BLOCK = 1 << 20


def _small(n: int) -> None:
    if n > LIMIT:
        raise ValueError(f"the shorter side is {n}; at most {LIMIT} can be factored")


def rows_of(a: Tensor) -> DataFrame:
    """(i0, row): each stored row as an array. A row's entries meet in one task; a row has at most as many as the matrix has columns."""
    n = a.shape[1]
    parts = [V()["re"], V()["im"]] if types.is_complex(a.dtype) else [V().cast("double")]
    grouped = a.df.groupBy("i0").agg(F.sort_array(F.collect_list(F.struct("i1", *(p.alias(f"x{k}") for k, p in enumerate(parts))))).alias("p"))

    def filled(name: str):
        full = F.transform("p", lambda x: x[name])
        some = F.map_from_arrays(F.transform("p", lambda x: x["i1"]), full)
        return F.when(F.size("p") == n, full).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda j: F.coalesce(F.try_element_at(some, j), F.lit(0.0))))

    return grouped.select("i0", F.concat(*(filled(f"x{k}") for k in range(len(parts)))).alias("row"))


def from_rows(rows: DataFrame, shape, dtype: str = "float64") -> Tensor:
    n = int(shape[1])
    if types.is_complex(dtype):
        rows = rows.withColumn("row", F.zip_with(F.slice("row", 1, n), F.slice("row", n + 1, n), lambda x, y: F.struct(x.alias("re"), y.alias("im"))))
    df = rows.select("i0", F.posexplode("row").alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")
    return Tensor(df, shape, dtype, None, False)


def _stacked(rows: pa.Array, complex_: bool) -> np.ndarray:
    """Lists of one length as a matrix, without an object for each."""
    x = rows.flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(len(rows), len(x) // max(1, len(rows)))
    n = x.shape[1] // 2
    return x[:, :n] + 1j * x[:, n:] if complex_ else x


def _split(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(np.concatenate([x.real, x.imag], axis=1) if np.iscomplexobj(x) else x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _height(width: int) -> int:
    """Rows in a block."""
    return max(1, BLOCK // (8 * max(1, width)))


def _blocks(batches: Iterator[pa.RecordBatch], complex_: bool, width: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in blocks of rows, which have at most BLOCK bytes (or one row), with rows of that width too."""
    for b in batches:
        if b.num_rows:
            step = _height(max(width, len(b.column("row").flatten()) // b.num_rows))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                yield part, _stacked(part.column("row"), complex_)


def _numbered(x: np.ndarray, name: str | None = None) -> Iterator[pa.RecordBatch]:
    """A matrix's rows, block by block; under a name also their numbers."""
    step = _height(x.shape[1] * (1 + np.iscomplexobj(x)))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        at = {name: pa.array(np.arange(k, k + len(part)))} if name else {}
        yield pa.RecordBatch.from_pydict({**at, "row": _split(part)})


def _mapped(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], complex_: bool, width: int) -> DataFrame:
    """f on blocks of rows, in tasks; its rows have that many doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, complex_, width):
            yield pa.RecordBatch.from_arrays([b.column("i0"), _split(f(x))], ["i0", "row"])

    blocked.bound_batches(rows.sparkSession)
    return rows.select("i0", "row").mapInArrow(run, "i0 long, row array<double>")


def _reduced(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], complex_: bool, first: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray | None:
    """f, which makes rows few, of what it gave and the next rows (after first) within tasks, and of what the tasks give in rounds until few are left; small matrices all along."""

    def run(batches: Iterator[pa.RecordBatch], first=None) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        more = 0
        for _, x in _blocks(batches, complex_):
            held.append(x if first is None else first(x))
            more += len(x)
            # As many rows as columns at least, or what is held would be worked on again for few.
            if more >= x.shape[1]:
                held, more = [f(np.concatenate(held))], 0
        if more:
            held = [f(np.concatenate(held))]
        if held:
            yield from _numbered(held[0])

    blocked.bound_batches(rows.sparkSession)
    rows = rows.select("row").mapInArrow(lambda batches: run(batches, first), "row array<double>")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 8:
        parts = max(1, parts // 8)
        rows = rows.repartition(parts).mapInArrow(run, "row array<double>")
    found = [_stacked(c, complex_) for c in rows.toArrow().column("row").chunks if len(c)]
    return f(np.concatenate(found)) if found else None


def gram(a: Tensor) -> np.ndarray:
    """A^H A. Each task sums the outer products of its rows, so the shuffle has a matrix a task, summed by entry."""
    _small(a.shape[1])
    n, complex_ = a.shape[1], types.is_complex(a.dtype)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), "complex128" if complex_ else float)
        for _, x in _blocks(batches, complex_):
            total += x.conj().T @ x
        yield from _numbered(total, "j")

    blocked.bound_batches(a.spark)
    parts = rows_of(a).mapInArrow(partial, "j long, row array<double>")
    sums = parts.select("j", F.posexplode("row").alias("k", "v")).groupBy("j", "k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((n, n * (1 + complex_)))
    out[sums.column("j").to_numpy(), sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    return out[:, :n] + 1j * out[:, n:] if complex_ else out


def _times(a: Tensor, m: np.ndarray) -> Tensor:
    """A m for a small m: each row in its task, no shuffle beyond the rows'."""
    return _rows_times(rows_of(a), m, a.shape[0], types.is_complex(a.dtype))


def product(a: Tensor, b: Tensor) -> Tensor:
    """A B: where B's shorter side is small, blocks of A's rows times B in tasks; where B is large and the side they share small and both are dense, blocks of rows times blocks of columns, each pair in a task; else a contraction."""
    if b.shape[0] * b.shape[1] <= LIMIT * LIMIT // 4:
        return _times(a, b.to_numpy())
    if a.shape[1] <= LIMIT and not types.is_complex(a.dtype) and not types.is_complex(b.dtype) and all(t.df.count() >= blocked.DENSE * t.size for t in (a, b)):
        return _block_pairs(a, b)
    return einsum("ij,jk->ik", a, b)


#: Bytes of a block of rows, and places of the result that a task hands on at once.
ROWS, PLACES = 1 << 20, 1 << 17
#: Parts that each side's blocks are dealt into; each pair of parts is a task.
PARTS = 32


def _row_blocks(rows: DataFrame, n: int) -> DataFrame:
    """(at, data): blocks of rows with their numbers, as bytes, written once and dealt evenly."""
    most = max(1, ROWS // (8 * max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), n)
            for k in range(0, len(b), most):
                yield pa.RecordBatch.from_arrays([pa.array([x[k : k + most].tobytes()], pa.binary()) for x in (at, values)], ["at", "data"])

    return checkpointed(rows.mapInArrow(run, "at binary, data binary").repartition(PARTS))


def _block_pairs(a: Tensor, b: Tensor) -> Tensor:
    """A B by a Cartesian product of blocks: a task reads a part of A's rows and one of B's columns, block by block, and hands on the result in batches. Nothing as large as the result is shuffled, written or held."""
    n = a.shape[1]
    left, right = _row_blocks(rows_of(a), n), _row_blocks(rows_of(b.transpose()), n)
    blocked.bound_batches(a.spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, j, y in zip(*(batch.column(c) for c in range(4))):
                i, j = (np.frombuffer(v.as_buffer(), np.int64) for v in (i, j))
                x, y = (np.frombuffer(v.as_buffer(), float).reshape(-1, n) for v in (x, y))
                step = max(1, PLACES // len(j))
                for k in range(0, len(i), step):
                    own = i[k : k + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(j))), pa.array(np.tile(j, len(own))), pa.array((x[k : k + step] @ y.T).ravel())], ["i0", "i1", "v"])

    pairs = left.toDF("i", "x").hint("shuffle_replicate_nl").crossJoin(right.toDF("j", "y"))
    return Tensor(pairs.mapInArrow(run, "i0 bigint, i1 bigint, v double"), (a.shape[0], b.shape[1]), "float64", None, False)


def _rows_times(rows: DataFrame, m: np.ndarray, height: int, complex_: bool) -> Tensor:
    shared = rows.sparkSession.sparkContext.broadcast(m)
    dtype = "complex128" if complex_ or np.iscomplexobj(m) else "float64"
    return from_rows(_mapped(rows, lambda x: (x @ shared.value).astype(dtype), complex_, m.shape[1] * (1 + types.is_complex(dtype))), (height, m.shape[1]), dtype)


def _signed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs such that each row of v has its largest entry positive."""
    at = np.argmax(np.abs(v), axis=1)
    phase = v[np.arange(len(v)), at]
    phase = np.where(phase == 0, 1, phase / np.where(phase == 0, 1, np.abs(phase)))
    return u * phase[None, :], v / phase[:, None]


def svd(a: Tensor, rank: int | None = None, threshold: float | None = None) -> tuple[Tensor, np.ndarray, Tensor]:
    """(U, s, Vt), s descending: singular values of at least threshold, then at most rank of them.

    A tall matrix is first reduced by QR, so that small singular values keep their digits.
    """
    m, n = a.shape
    if m < n:
        u, s, vt = svd(a.conj().transpose() if types.is_complex(a.dtype) else a.transpose(), rank, threshold)
        turn = (lambda x: x.conj().transpose()) if types.is_complex(a.dtype) else (lambda x: x.transpose())
        return turn(vt), s, turn(u)
    _small(n)
    rows, change, r = _orthogonal(a)
    u, s, vt = np.linalg.svd(r)
    keep = len(s) if threshold is None else int((s >= threshold).sum())
    keep = keep if rank is None else min(keep, rank)
    u, vt = _signed(u[:, :keep], vt[:keep])
    return _rows_times(rows, change(u), m, types.is_complex(a.dtype)), s[:keep], Tensor.from_numpy(a.spark, vt)


def _triangle(x: np.ndarray) -> np.ndarray:
    """R of a QR, its diagonal positive."""
    r = np.linalg.qr(x, mode="r")
    d = np.diag(r)
    phase = np.where(d == 0, 1, d / np.where(d == 0, 1, np.abs(d)))
    return r * phase.conj()[:, None]


def _triangle_of(rows: DataFrame, n: int, complex_: bool, change: np.ndarray | None = None) -> np.ndarray:
    """R of the rows (times a small matrix) from a tree of factorisations."""
    shared = None if change is None else rows.sparkSession.sparkContext.broadcast(change)
    r = _reduced(rows, _triangle, complex_, None if change is None else lambda x: x @ shared.value)
    r = np.zeros((0, n), "complex128" if complex_ else float) if r is None else r
    return np.concatenate([r, np.zeros((n - len(r), n))]) if len(r) < n else r


def _orthogonal(a: Tensor) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """For a tall matrix: rows, written once; a function from m to M such that Q m = rows M; and R. A matrix without full rank gets columns of fixed noise beside its rows, from which the missing columns of Q are made."""
    n, complex_ = a.shape[1], types.is_complex(a.dtype)
    rows = checkpointed(rows_of(a))
    r = _triangle_of(rows, n, complex_)
    d = np.abs(np.diag(r))
    if n and d.min() > 1e-10 * d.max():
        first = np.linalg.inv(r)
        again = _triangle_of(rows, n, complex_, first)
        second = first @ np.linalg.inv(again)
        return rows, lambda m: second @ m, again @ r
    # Orthonormal columns for the range from R's singular vectors, and for the rest from noise without its part in the range.
    _, s, vt = np.linalg.svd(r)
    k = int((s > 1e-10 * max(s.max(initial=0.0), 1e-300)).sum())
    noise = F.array(*(F.shiftrightunsigned(F.xxhash64(F.lit(c), F.col("i0")), 11).cast("double") / float(1 << 53) - 0.5 for c in range(n - k)))
    every = a.spark.range(a.shape[0]).select(F.col("id").alias("i0")).join(rows, "i0", "left")
    blank = F.array_repeat(F.lit(0.0), n * (1 + complex_))
    row = F.coalesce("row", blank)
    wide = F.concat(F.slice(row, 1, n), noise, F.slice(row, n + 1, n), F.array_repeat(F.lit(0.0), n - k)) if complex_ else F.concat(row, noise)
    rows = checkpointed(every.select("i0", wide.alias("row")))
    basis = np.zeros((2 * n - k, n), "complex128" if complex_ else float)
    basis[:n, :k] = vt[:k].conj().T / s[:k]
    basis[n:, k:] = np.eye(n - k)
    for _ in range(3):
        basis = basis @ np.linalg.inv(_triangle_of(rows, n, complex_, basis))
    small, upper = np.linalg.qr(np.concatenate([_product(rows, basis, n, complex_), np.zeros((0, n))]))
    return rows, lambda m: basis @ (small @ m), upper


def _product(rows: DataFrame, basis: np.ndarray, n: int, complex_: bool) -> np.ndarray:
    """(rows basis)^H times the first n columns of rows, summed in tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, complex_):
            own = (x @ shared.value).conj().T @ x[:, :n]
            total = own if total is None else total + own
        if total is not None:
            yield from _numbered(total, "j")

    blocked.bound_batches(rows.sparkSession)
    sums = rows.mapInArrow(partial, "j long, row array<double>").select("j", F.posexplode("row").alias("k", "v")).groupBy("j", "k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((n, n * (1 + complex_)))
    if len(sums):
        out[sums.column("j").to_numpy(), sums.column("k").to_numpy()] = sums.column("v").to_numpy()
    return out[:, :n] + 1j * out[:, n:] if complex_ else out


def qr(a: Tensor) -> tuple[Tensor, Tensor]:
    """Reduced QR. Of a tall matrix tasks factor blocks of rows, their triangles are factored in rounds until few are left; Q = A R^-1, done twice. Of a wide one the leading square gives Q, and R = Q^H A."""
    m, n = a.shape
    _small(min(m, n))
    if m < n:
        q, _ = qr(a[:, :m])
        return q, einsum("ij,ik->jk", q.conj() if types.is_complex(q.dtype) else q, a)
    rows, change, r = _orthogonal(a)
    return _rows_times(rows, change(np.eye(n)), m, types.is_complex(a.dtype)), Tensor.from_numpy(a.spark, np.triu(r))


def svd_rand(a: Tensor, rank: int, iterations: int = 1, oversample: int = 5, seed: int = 0) -> tuple[Tensor, np.ndarray, Tensor]:
    """Randomised subspace iteration: a few products with A and A^T, then the SVD of a small matrix."""
    m, n = a.shape
    k = min(rank + oversample, m, n)
    star = a.conj() if types.is_complex(a.dtype) else a
    a = a._with(checkpointed(a.df))
    q = _times(a, np.random.default_rng(seed).standard_normal((n, k)))
    for _ in range(iterations):
        q, _ = qr(q)
        z, _ = qr(einsum("ij,ik->jk", star, q))
        q = einsum("ij,jk->ik", a, z)
    q, _ = qr(q)
    q = q._with(checkpointed(q.df))
    small = einsum("ik,ij->kj", q.conj() if types.is_complex(q.dtype) else q, a)
    u, s, vt = svd(small, rank)
    return _times(q, u.to_numpy()), s, vt


def svd_batch(a: Tensor, rank: int | None = None) -> tuple[Tensor, Tensor, Tensor]:
    """SVD of each leading slice of an order-3 tensor, slices side by side in tasks."""
    b, m, n = a.shape
    k = min(m, n) if rank is None else min(rank, m, n)
    _small(min(m, n))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((m, n))
        x[pdf["i1"], pdf["i2"]] = pdf["v"]
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        u, vt = _signed(u[:, :k], vt[:k])
        parts = [("u", *np.indices((m, k)).reshape(2, -1), u.ravel()), ("s", np.arange(k), np.zeros(k, int), s[:k]), ("v", *np.indices((k, n)).reshape(2, -1), vt.ravel())]
        return pd.concat([pd.DataFrame({"part": p, "i0": key[0], "i1": i, "i2": j, "v": v}) for p, i, j, v in parts])

    out = checkpointed(a.df.groupBy("i0").applyInPandas(run, "part string, i0 long, i1 long, i2 long, v double"))
    part = lambda p: out.where(F.col("part") == p).drop("part")
    return Tensor(part("u"), (b, m, k), sparse=False), Tensor(part("s").drop("i2"), (b, k), sparse=False), Tensor(part("v"), (b, k, n), sparse=False)


def cholesky(a: Tensor, tile: int = tiled.TILE) -> Tensor:
    """Lower factor of a Hermitian positive definite matrix, tile by tile in tasks; its lower triangle is read."""
    return tiled.cholesky(a, tile).to_tensor()


def solve_tri(l: Tensor, b: Tensor, lower: bool = True, from_left: bool = True, transposed: bool = False, tile: int = tiled.TILE) -> Tensor:  # noqa: E741
    """X with op(L) X = B, or X op(L) = B; only one triangle of L is read. Rows of tiles are solved one after the other, columns of B side by side."""
    return tiled.solve_tri(l, b, lower, from_left, transposed, tile).to_tensor()


def solve_spd(m: Tensor, b: Tensor, tile: int = tiled.TILE) -> Tensor:
    """X with X M = B for a symmetric (Hermitian) positive definite M: its factor, then two triangular systems, all in tiles."""
    return tiled.solve_spd(m, b, tile).to_tensor()


def eigenpairs(a: Tensor, k: int, tile: int = tiled.TILE, **options) -> tuple[np.ndarray, Tensor]:
    """(values descending, vectors as columns): the k leading eigenpairs of a symmetric or Hermitian matrix of any size, by block Lanczos iteration in tasks."""
    values, vectors = tiled.eigenpairs(a, k, tile, **options)
    return values, vectors.to_tensor()


def eigh(a: Tensor) -> tuple[np.ndarray, Tensor]:
    """(eigenvalues ascending, eigenvectors): all of a symmetric or Hermitian matrix that the driver can hold. eigenpairs() gives the leading ones of any."""
    _small(a.shape[0])
    d, u = np.linalg.eigh(a.to_numpy())
    return d, Tensor.from_numpy(a.spark, _signed(u, u.T.copy())[0] if not np.iscomplexobj(u) else u)
