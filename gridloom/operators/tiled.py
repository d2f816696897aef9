"""Factorisations of square matrices in tiles, and leading eigenpairs, none of which passes through the driver as a whole.

A matrix is a relation of tiles (b0, b1, values). Cholesky's step takes a column of tiles: tasks factor its diagonal tile and divide the tiles below it,
and a join of that panel with itself takes its products off what is left to the right. Triangular systems go down (or up) the rows of tiles the
same way. A step's panel and remainder are written to the shared folder, so a step is as long as its own tiles, whatever came before. A side of n has
n / tile steps; a task holds a few tiles at a time.

Eigenpairs come from a block Lanczos iteration with thick restarts: the basis is a relation of row blocks, products and inner products
are contractions in blocks, and only the projected matrix, as wide as the basis has vectors, is worked on by the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..sources.checkpoint import checkpointed
from . import blocked
from .blocked import Blocked
from .tensor import Tensor

#: Side of a tile: 512 KB of doubles.
TILE = 256
#: Side below which a triangle is solved row by row.
SMALL = 32

TILES = "b0 bigint, b1 bigint, data binary"


def lower_solve(l: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: E741
    """X with L X = B for a lower triangle, by halves."""
    n = len(l)
    if n <= SMALL:
        x = np.array(b, np.result_type(l, b, float))
        for i in range(n):
            x[i] = (x[i] - l[i, :i] @ x[:i]) / l[i, i]
        return x
    h = n // 2
    first = lower_solve(l[:h, :h], b[:h])
    return np.concatenate([first, lower_solve(l[h:, h:], b[h:] - l[h:, :h] @ first)])


def upper_solve(u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """X with U X = B for an upper triangle."""
    return lower_solve(u[::-1, ::-1], b[::-1])[::-1]


def _floating(t: Tensor | Blocked) -> str:
    return "complex128" if types.is_complex(t.dtype) else "float64"


def tiles_of(a: Tensor | Blocked, tile: int | tuple[int, int]) -> Blocked:
    """A matrix in tiles of doubles (or complex ones)."""
    tile = (tile, tile) if isinstance(tile, int) else tile
    if isinstance(a, Tensor):
        to = _floating(a)
        return Blocked.from_tensor(a if a.dtype == to else a.astype(to), tile)
    return a.cut(tile).astype(_floating(a))


def _joined(rows: DataFrame, columns: list[tuple[str, str, str]], f: Callable[..., np.ndarray], shape, block, dtype: str) -> DataFrame:
    """f(coordinates of the first tile, tiles ..) for each row, as the tile of those coordinates. columns: names (b0, b1, data) of each tile in a row; one without data is None."""
    names = [n for c in columns for n in c]
    rows = rows.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [b.column(3 * k + j).to_pylist() for k in range(len(columns)) for j in (0, 1)]
            data = [b.column(3 * k + 2) for k in range(len(columns))]
            for n in range(len(b)):
                own = []
                for k in range(len(columns)):
                    value = data[k][n]
                    own.append(blocked._array(value.as_buffer(), (at[2 * k][n], at[2 * k + 1][n]), shape[k], block[k], dtype) if value.is_valid else None)
                yield blocked._row((at[0][n], at[1][n]), f((at[0][n], at[1][n]), *own))

    return rows.mapInArrow(run, TILES)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("b0").alias(f"{prefix}0"), F.col("b1").alias(f"{prefix}1"), F.col("data").alias(f"{prefix}d"))


def _triple(prefix: str) -> tuple[str, str, str]:
    return f"{prefix}0", f"{prefix}1", f"{prefix}d"


def cholesky(a: Tensor | Blocked, tile: int = TILE) -> Blocked:
    """The lower factor L of a Hermitian positive definite A = L L^H, of which only the lower triangle is read."""
    a = tiles_of(a, tile)
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"a square matrix is needed, not one of {a.shape}")
    shape, block, dtype = a.shape, a.block, a.dtype
    steps = a.counts[0]
    left = checkpointed(a.df.where("b0 >= b1"))
    done: list[DataFrame] = []
    for k in range(steps):
        column, diagonal = left.where(F.col("b1") == k), left.where((F.col("b0") == k) & (F.col("b1") == k))
        met = _named(column, "a").join(_named(diagonal, "d"), F.col("a1") == F.col("d1"))

        def divided(at: tuple[int, int], own: np.ndarray, pivot: np.ndarray) -> np.ndarray:
            low = np.linalg.cholesky(np.tril(pivot) + np.tril(pivot, -1).conj().T)
            return low if at[0] == at[1] else lower_solve(low, own.conj().T).conj().T

        panel = checkpointed(_joined(met, [_triple("a"), _triple("d")], divided, [shape] * 2, [block] * 2, dtype))
        done.append(panel)
        if k + 1 < steps:
            below = panel.where(F.col("b0") > k)
            # What the panel takes off each tile to the right; tiles that were zero so far come into being.
            taken = _named(below, "x").join(_named(below, "y").withColumnRenamed("y1", "x1"), "x1").where("x0 >= y0")
            taken = taken.select(F.col("x0").alias("b0"), F.col("y0").alias("b1"), "x0", "x1", "xd", "y0", F.col("x1").alias("y1"), "yd")
            both = _named(left.where(F.col("b1") > k), "a").join(taken, (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1")), "full_outer")
            both = both.withColumn("a0", F.coalesce("a0", "b0")).withColumn("a1", F.coalesce("a1", "b1"))
            both = both.select("a0", "a1", "ad", F.coalesce("x0", "a0").alias("x0"), F.lit(k).cast("bigint").alias("x1"), "xd", F.coalesce("y0", "a1").alias("y0"), F.lit(k).cast("bigint").alias("y1"), "yd")
            less = lambda at, own, x, y: own if x is None else (0 if own is None else own) - x @ y.conj().T
            left = checkpointed(_joined(both, [_triple("a"), _triple("x"), _triple("y")], less, [shape] * 3, [block] * 3, dtype))
    out = done[0]
    for panel in done[1:]:
        out = out.unionByName(panel)
    return Blocked(out, shape, block, dtype)


def _substituted(l: Blocked, b: Blocked, order: list[int], solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Blocked:  # noqa: E741
    """X with T X = B for a triangle T of tiles: rows of tiles are solved in an order, and each takes its part off the ones to come."""
    to = types.promote(l.dtype, b.dtype)
    l, b = l.astype(to), b.astype(to)  # noqa: E741
    tiles, rest = checkpointed(l.df), checkpointed(b.df)
    shape, block = [b.shape, l.shape], [b.block, l.block]
    done: list[DataFrame] = []
    for step, k in enumerate(order):
        met = _named(rest.where(F.col("b0") == k), "a").join(_named(tiles.where((F.col("b0") == k) & (F.col("b1") == k)), "d"), F.col("a0") == F.col("d0"))
        solved = checkpointed(_joined(met, [_triple("a"), _triple("d")], lambda at, own, t: solve(t, own), shape, block, to))
        done.append(solved)
        left = order[step + 1 :]
        if left:
            coming = (F.col("b0") > k) if left[0] > k else (F.col("b0") < k)
            pairs = _named(tiles.where((F.col("b1") == k) & coming), "t").join(_named(solved, "x"), F.col("t1") == F.col("x0"))
            pairs = pairs.select(F.col("t0").alias("b0"), F.col("x1").alias("b1"), *_triple("t"), *_triple("x"))
            both = _named(rest.where(coming), "a").join(pairs, (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1")), "full_outer")
            both = both.withColumn("a0", F.coalesce("a0", "b0")).withColumn("a1", F.coalesce("a1", "b1"))
            here = F.lit(k).cast("bigint")
            both = both.select("a0", "a1", "ad", F.coalesce("t0", "a0").alias("t0"), here.alias("t1"), "td", here.alias("x0"), F.coalesce("x1", "a1").alias("x1"), "xd")
            less = lambda at, own, t, x: own if t is None else (0 if own is None else own) - t @ x
            rest = checkpointed(_joined(both, [_triple("a"), _triple("t"), _triple("x")], less, [b.shape, l.shape, b.shape], [b.block, l.block, b.block], to))
    out = done[0]
    for solved in done[1:]:
        out = out.unionByName(solved)
    return Blocked(out, b.shape, b.block, to)


def solve_tri(l: Tensor | Blocked, b: Tensor | Blocked, lower: bool = True, from_left: bool = True, transposed: bool = False, tile: int = TILE) -> Blocked:  # noqa: E741
    """X with op(L) X = B, or X op(L) = B; op transposes where asked. Only the triangle named by lower is read."""
    l = tiles_of(l, tile)  # noqa: E741
    b = tiles_of(b, (l.block[0], tile) if from_left else (tile, l.block[0]))
    if l.shape[0] != l.shape[1] or b.shape[0 if from_left else 1] != l.shape[0]:
        raise ValueError(f"a triangle of {l.shape} doesn't fit {b.shape}")
    if not from_left:
        return solve_tri(l, b.T, lower, True, not transposed, tile).T
    l = l._with(l.df.where("b0 >= b1" if lower else "b0 <= b1"))  # noqa: E741
    l, lower = (l.T, not lower) if transposed else (l, lower)  # noqa: E741
    steps = list(range(l.counts[0]))
    if lower:
        return _substituted(l, b, steps, lambda t, x: lower_solve(np.tril(t), x))
    return _substituted(l, b, steps[::-1], lambda t, x: upper_solve(np.triu(t), x))


def solve_spd(m: Tensor | Blocked, b: Tensor | Blocked, tile: int = TILE) -> Blocked:
    """X with X M = B for a Hermitian positive definite M = L L^H: Z L^H = B, then X L = Z."""
    low = cholesky(m, tile).written()
    half = solve_tri(low.conj(), b, True, False, True, tile)
    return solve_tri(low, half, True, False, False, tile)


# Leading eigenpairs


class _Basis:
    """Row blocks (b0, q, w) of two narrow matrices: a basis Q and its image W = A Q. What both need is in one row, so inner products and combinations join nothing."""

    def __init__(self, df: DataFrame, n: int, height: int, q: int, w: int, dtype: str):
        self.df, self.n, self.height, self.q, self.w, self.dtype = df, n, height, q, w, dtype

    def _rows(self) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
        n, height, q, w, dtype = self.n, self.height, self.q, self.w, self.dtype

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for k, at in enumerate(batch.column(0).to_pylist()):
                m = min(height, n - at * height)
                yield at, np.frombuffer(batch.column(1)[k].as_buffer(), dtype).reshape(m, q), np.frombuffer(batch.column(2)[k].as_buffer(), dtype).reshape(m, w)

        return rows

    def inner(self, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
        """The sum of X^H Y over row blocks, (X, Y) = f(q, w): within tasks, then in rounds until few small matrices are left."""
        rows, dtype = self._rows(), self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, dtype)
            for b in batches:
                for _, q, w in rows(b):
                    x, y = f(q, w)
                    total += x.conj().T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, dtype)
            for b in batches:
                for x in b.column(0):
                    total += np.frombuffer(x.as_buffer(), dtype).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

        sums = self.df.select("b0", "q", "w").mapInArrow(run, "data binary")
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while parts > 16:
            parts = max(1, parts // 16)
            sums = sums.repartition(parts).mapInArrow(added, "data binary")
        total = np.zeros(shape, dtype)
        for x in sums.toArrow().column(0).to_pylist():
            total += np.frombuffer(x, dtype).reshape(shape)
        return total

    def block(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> Blocked:
        """f(q, w) of each row block, as a matrix of its own."""
        rows, dtype = self._rows(), self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, q, w in rows(b):
                    yield blocked._row((at, 0), f(q, w).astype(dtype))

        return Blocked(self.df.select("b0", "q", "w").mapInArrow(run, TILES), (self.n, width), (self.height, width), dtype)

    def mapped(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], q: int, w: int, image: Blocked | None = None) -> _Basis:
        """Written row blocks of f(q, w, block of the image)."""
        rows, dtype, width = self._rows(), self.dtype, image.shape[1] if image else 0
        df = self.df.select("b0", "q", "w")
        if image is not None:
            df = df.join(image.df.select("b0", F.col("data").alias("image")), "b0", "left").select("b0", "q", "w", "image")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, (at, x, y) in enumerate(rows(b)):
                    own = b.column(3)[k] if width else None
                    z = np.frombuffer(own.as_buffer(), dtype).reshape(len(x), width) if width and own.is_valid else np.zeros((len(x), width), dtype)
                    x, y = f(x, y, z)
                    parts = [pa.array([np.ascontiguousarray(m.astype(dtype)).tobytes()], pa.binary()) for m in (x, y)]
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *parts], ["b0", "q", "w"])

        return _Basis(checkpointed(df.mapInArrow(run, "b0 bigint, q binary, w binary")), self.n, self.height, q, w, dtype)


#: A direction whose square is less than this share of the largest one's can't be told from rounding in a Gram matrix.
LEAST = 1e-13


def _root(g: np.ndarray, least: float) -> np.ndarray:
    """T with T^H G T = 1, over the directions whose square is above least."""
    d, u = np.linalg.eigh((g + g.conj().T) / 2)
    keep = d > max(least * d.max(initial=0.0), 1e-300)
    return u[:, keep] / np.sqrt(d[keep])


def _fresh(x: _Basis) -> tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], int]:
    """A function of a row block's (q, w), and how many columns it gives: an orthonormal basis of what W has outside of Q. The basis is taken off twice, and directions are made orthonormal twice, as the first time leaves what was rounded."""
    size, wide = x.q, x.w
    c = x.inner(lambda q, w: (q, w), (size, wide))
    both = lambda q, r: (np.concatenate([q, r], axis=1), r)
    first = lambda q, w: w - q @ c
    g = x.inner(lambda q, w: both(q, first(q, w)), (size + wide, wide))
    c2, t = g[:size], _root(g[size:] - g[:size].conj().T @ g[:size], LEAST)
    second = lambda q, w: (first(q, w) - q @ c2) @ t
    if not t.shape[1]:
        return second, 0
    g = x.inner(lambda q, w: both(q, second(q, w)), (size + t.shape[1], t.shape[1]))
    # After the first time all are of length one, but those that were rounding only.
    c3, t3 = g[:size], _root(g[size:] - g[:size].conj().T @ g[:size], 0.25)
    return (lambda q, w: (second(q, w) - q @ c3) @ t3), t3.shape[1]


def eigenpairs(a: Tensor | Blocked, k: int, tile: int = TILE, steps: int = 3, restarts: int = 100, tolerance: float = 1e-9, seed: int = 0, magnitude: bool = False) -> tuple[np.ndarray, Blocked]:
    """(values, vectors): the k largest eigenvalues of a Hermitian matrix, descending (magnitude: by size), and their vectors as columns.

    steps: blocks of a basis between restarts; a block has k vectors and a few more. Iteration ends as every residual
    |A x - value x| is at most tolerance times the largest value by size, and raises ArithmeticError after `restarts`.
    """
    a = tiles_of(a, tile)
    n = a.shape[0]
    if n != a.shape[1]:
        raise ValueError(f"a square matrix is needed, not one of {a.shape}")
    k = min(k, n)
    a = a.written()
    wide = min(n, k + max(2, k // 4))
    x = _noise(a, wide, seed)
    for turn in range(restarts):
        for _ in range(steps - (turn > 0)):
            fresh, more = _fresh(x) if x.q < n else (None, 0)
            if not more:
                # The basis spans all, or what A maps onto itself.
                break
            image = blocked.einsum("ij,jk->ik", a, x.block(fresh, more))
            beside = (lambda q, w, z, f=fresh: (f(q, w), z)) if not x.q else (lambda q, w, z, f=fresh: (np.concatenate([q, f(q, w)], axis=1), np.concatenate([w, z], axis=1)))
            x = x.mapped(beside, x.q + more, (x.w if x.q else 0) + more, image)
        h = x.inner(lambda q, w: (q, w), (x.q, x.w))
        values, s = np.linalg.eigh((h + h.conj().T) / 2)
        order = np.argsort(-(np.abs(values) if magnitude else values), kind="stable")[:wide]
        s, found = s[:, order], values[order]
        x = x.mapped(lambda q, w, _, s=s: (q @ s, w @ s), len(order), len(order))
        left = lambda q, w, d=found: (w - q * d, w - q * d)
        away = np.sqrt(np.abs(np.diag(x.inner(left, (len(order), len(order))))))[:k]
        if (away <= tolerance * max(np.abs(values).max(), 1e-300)).all():
            return found[:k], x.block(lambda q, w: q[:, :k], min(k, x.q))
    raise ArithmeticError(f"no {k} eigenpairs after {restarts} restarts: residuals up to {away.max():.2g}")


def _noise(a: Blocked, width: int, seed: int) -> _Basis:
    """No basis yet, and normal numbers in place of its image; they follow from seed and row block, whatever the partitioning."""
    n, height, dtype = a.shape[0], a.block[0], a.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                values = np.random.default_rng([seed, k]).standard_normal((min(height, n - k * height), width)).astype(dtype)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([b""], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["b0", "q", "w"])

    return _Basis(a.spark.range(ceil(n / height)).mapInArrow(run, "b0 bigint, q binary, w binary"), n, height, 0, width, dtype)
