"""Kernels of tensor decompositions. Factor matrices are handed over as arrays, so they are small enough for every task; sparse tensors stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from . import linalg
from .tensor import V, Tensor, einsum


def _factor(a: Tensor, m: Tensor | DataFrame | np.ndarray, mode: int) -> DataFrame:
    """(i_mode, row_mode) of a factor matrix, which may be given as rows (i0, row) already; a vector counts as one column."""
    if isinstance(m, DataFrame):
        rows = m
    elif isinstance(m, np.ndarray):
        m = m.reshape(len(m), -1).astype(float)
        rows = a.spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "i0 long, row array<double>")
    else:
        rows = linalg.rows_of(m.reshape(m.shape[0], -1))
    return rows.select(F.col("i0").alias(f"i{mode}"), F.col("row").alias(f"row{mode}"))


def _with_rows(a: Tensor, factors: Sequence, skip: int | None = None) -> tuple[DataFrame, Column]:
    """The tensor's rows with the product of their factor rows. Joins are on a mode each; adaptive execution broadcasts factors that are small."""
    df, product = a.df, None
    for k, m in enumerate(factors):
        if m is None or k == skip:
            continue
        df = df.join(_factor(a, m, k), f"i{k}")
        row = F.col(f"row{k}")
        product = row if product is None else F.zip_with(product, row, lambda x, y: x * y)
    return df, product


def tttp(a: Tensor, factors: Sequence) -> Tensor:
    """Each stored value times the sum over r of the product of the factors' entries. None leaves a mode out."""
    df, product = _with_rows(a, factors)
    if product is None:
        return a.copy()
    return a._with(df.select(*a.keys, (V() * F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).alias("v")))


def mttkrp(a: Tensor, factors: Sequence, mode: int) -> Tensor:
    """M[i_mode, r] = sum of values times the product of the other factors' rows. Sums of the row's components combine before the shuffle."""
    rank = next((m.shape[1] if len(m.shape) > 1 else 1) for k, m in enumerate(factors) if m is not None and k != mode)
    df, product = _with_rows(a, factors, skip=mode)
    weighted = df.select(f"i{mode}", F.transform(product, lambda x: x * V()).alias("row"))
    sums = weighted.groupBy(f"i{mode}").agg(*(F.sum(F.get("row", F.lit(r))).alias(f"r{r}") for r in range(rank)))
    rows = sums.select(F.col(f"i{mode}").alias("i0"), F.array(*(f"r{r}" for r in range(rank))).alias("row"))
    return linalg.from_rows(rows, (a.shape[mode], rank))


def solve_factor(a: Tensor, factors: Sequence, rhs: Tensor, mode: int, regularise: float = 0.0) -> Tensor:
    """Row i of a mode: x with (sum over stored entries of value u u^T) x = rhs[i], u the product of the other factors' rows.

    The matrices' upper triangles are summed as columns, combined before the shuffle, so a row with very many entries doesn't meet in one task; only R x R sums are solved in Python.
    """
    rank = rhs.shape[1]
    df, product = _with_rows(a, factors, skip=mode)
    u = df.select(f"i{mode}", V().alias("w"), product.alias("u"))
    at = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = u.groupBy(f"i{mode}").agg(*(F.sum(F.col("w") * F.get("u", F.lit(i)) * F.get("u", F.lit(j))).alias(f"g{i}_{j}") for i, j in at))
    grams = sums.select(F.col(f"i{mode}").alias("i0"), F.array(*(f"g{i}_{j}" for i, j in at)).alias("g"))
    return linalg.from_rows(_solved(grams.join(linalg.rows_of(rhs), "i0"), rank, regularise), (a.shape[mode], rank))


def _solved(both: DataFrame, rank: int, regularise: float) -> DataFrame:
    """(i0, row) from (i0, g, row): each row's system, g its matrix's upper triangle, solved in batches."""
    upper = np.triu_indices(rank)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            g = np.zeros((len(b), rank, rank))
            g[:, upper[0], upper[1]] = np.stack(b["g"].to_numpy())
            g[:, upper[1], upper[0]] = g[:, upper[0], upper[1]]
            x = np.linalg.solve(g + regularise * np.eye(rank), np.stack(b["row"].to_numpy())[:, :, None])[:, :, 0]
            yield pd.DataFrame({"i0": b["i0"], "row": list(x)})

    return both.mapInPandas(run, "i0 long, row array<double>")


def _update(a: Tensor, factors: Sequence, mode: int, rank: int, regularise: float) -> DataFrame:
    """(i0, row) of one mode's factor that fits the stored entries best, given the others. Matrices and right-hand sides come from the same joins and one aggregation, combined before its shuffle."""
    df, product = _with_rows(a, factors, skip=mode)
    u = df.select(f"i{mode}", V().alias("w"), product.alias("u"))
    at = [(i, j) for i in range(rank) for j in range(i, rank)]
    part = lambda i: F.get("u", F.lit(i))
    sums = u.groupBy(f"i{mode}").agg(*(F.sum(part(i) * part(j)).alias(f"g{i}_{j}") for i, j in at), *(F.sum(F.col("w") * part(i)).alias(f"b{i}") for i in range(rank)))
    return _solved(sums.select(F.col(f"i{mode}").alias("i0"), F.array(*(f"g{i}_{j}" for i, j in at)).alias("g"), F.array(*(f"b{i}" for i in range(rank))).alias("row")), rank, regularise)


def _start(a: Tensor, mode: int, rank: int, seed: int) -> DataFrame:
    """Rows of values in [-1, 1) that follow from the seed, for all places of a mode."""
    unit = lambda r: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(mode), F.lit(r), "id"), 11).cast("double") / F.lit(float(1 << 52)) - 1
    return a.spark.range(a.shape[mode]).select(F.col("id").alias("i0"), F.array(*(unit(r) for r in range(rank))).alias("row"))


def squared_error(a: Tensor, factors: Sequence) -> float:
    """Sum over the stored entries of the squared difference to the factors' product."""
    df, product = _with_rows(a, factors)
    off = V() - F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.sum(off * off)).first()[0] or 0.0


def completion(a: Tensor, rank: int, rounds: int = 10, regularise: float = 1e-9, start: Sequence[Tensor | None] | None = None, tolerance: float = 0.0, seed: int = 0) -> list[Tensor]:
    """Factors whose product is near the stored entries, by alternating least squares; places without an entry are unknown, not zero.

    A round solves for each mode in turn. The factors stay distributed, as rows in the shared folder. Rounds end early when one lowers the squared error by less
    than tolerance of what it was (0: no error is measured). Rows of a factor that no entry meets are zero. start: a factor for each mode, or None for a random one; the first isn't read.
    """
    factors = [_start(a, k, rank, seed) if start is None or start[k] is None else linalg.rows_of(start[k]) for k in range(a.ndim)]
    before = None
    for _ in range(rounds):
        for k in range(a.ndim):
            factors[k] = checkpointed(_update(a, factors, k, rank, regularise))
        if tolerance:
            error = squared_error(a, factors)
            if before is not None and before - error <= tolerance * before:
                break
            before = error
    return [linalg.from_rows(f, (n, rank)) for f, n in zip(factors, a.shape)]


def als(a: Tensor, rank: int, rounds: int = 3, seed: int = 0, regularise: float = 1e-9) -> list[np.ndarray]:
    """completion() of a small tensor, its factors as arrays."""
    return [f.to_numpy() for f in completion(a, rank, rounds, regularise, seed=seed)]


def unfold(a: Tensor, labels: str, left: str, right: str) -> Tensor:
    """A matrix: the modes of left as rows, of right as columns."""
    at = [labels.index(c) for c in left + right]
    shape = [a.shape[k] for k in at]
    return a.transpose(at).reshape(int(np.prod(shape[: len(left)])), int(np.prod(shape[len(left) :])))


def tensor_svd(x, left: str, right: str, rank: int | None = None, threshold: float | None = None, random: bool = False, iterations: int = 1, oversample: int = 5):
    """SVD between two groups of labels, which share one new label: e.g. left 'ija', right 'akl' of 'ijkl'."""
    (shared,) = set(left) & set(right) - set(x.labels)
    rows, columns = (s.replace(shared, "") for s in (left, right))
    lengths = dict(zip(x.labels, x.tensor.shape))
    m = unfold(x.tensor, x.labels, rows, columns)
    u, s, vt = linalg.svd_rand(m, rank, iterations, oversample) if random else linalg.svd(m, rank, threshold)
    k = len(s)
    u = u.reshape(*(lengths[c] for c in rows), k)
    vt = vt.reshape(k, *(lengths[c] for c in columns))
    place = lambda t, own, wanted: t.transpose([own.index(c) for c in wanted])
    return place(u, rows + shared, left), s, place(vt, shared + columns, right)


def hosvd(a: Tensor, ranks: Sequence[int]) -> tuple[list[Tensor], Tensor]:
    """Factor of each mode from the leading eigenvectors of its unfolding's Gram matrix, and the core. Gram matrices and vectors stay distributed."""
    letters = "abcdefghij"[: a.ndim]
    factors = []
    core = a
    for k, r in enumerate(ranks):
        other = letters[:k] + "z" + letters[k + 1 :]
        _, u = linalg.eigenpairs(einsum(f"{letters},{other}->{letters[k]}z", a, a), r)
        u = u._with(checkpointed(u.df))
        factors.append(u)
        core = ttm(core, u, k)
    return factors, core


def ttm(a: Tensor, m: np.ndarray | Tensor, mode: int) -> Tensor:
    """Mode `mode` of a contracted with the rows of a matrix; the matrix's columns take its place."""
    letters = "abcdefghij"[: a.ndim]
    m = Tensor.from_numpy(a.spark, m) if isinstance(m, np.ndarray) else m
    return einsum(f"{letters},{letters[mode]}z->{letters.replace(letters[mode], 'z')}", a, m)
