"""Symmetric tensors: packed storage of pairs of modes, and operators at its edges.

Kinds of a pair of neighbouring modes: NS none; SY v(i,j) = v(j,i), stored for i <= j; AS v(i,j) = -v(j,i) and SH symmetric with a
zero diagonal, both stored for i < j. A packed tensor's `stored` has that half, its `df` all entries, so every operator takes it as what
it stands for; `contract` gives a packed result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from .tensor import V, Tensor, einsum

KINDS = ("NS", "SY", "AS", "SH")


def _swapped(t: Tensor, a: int, b: int) -> list:
    other = {a: b, b: a}
    return [*(F.col(f"i{other.get(k, k)}").alias(f"i{k}") for k in range(t.ndim)), "v"]


def _kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"symmetry is one of {KINDS}")


def pack(t: Tensor, kind: str, a: int = 0, b: int = 1) -> Tensor:
    """Keep the stored half of a tensor that has the symmetry already."""
    _kind(kind)
    i, j = F.col(f"i{a}"), F.col(f"i{b}")
    return _packed(t, t.df if kind == "NS" else t.df.where(i <= j if kind == "SY" else i < j), kind, a, b)


def _packed(t: Tensor, stored: DataFrame, kind: str, a: int, b: int) -> Tensor:
    out = t._with(stored)
    out.sym = None if kind == "NS" else (kind, a, b)
    return out


def unpacked(t: Tensor) -> DataFrame:
    """All rows of a packed tensor: the stored half and its mirror."""
    kind, a, b = t.sym
    i, j = F.col(f"i{a}"), F.col(f"i{b}")
    stored = t.stored.where(i <= j if kind == "SY" else i < j)
    sign = types.negative(V(), t.dtype) if kind == "AS" else V()
    swapped = F.array(F.struct(*t.keys, "v"), F.struct(*_swapped(t, a, b)[:-1], sign.alias("v")))
    # One pass over the half: a row and, off the diagonal, its mirror.
    both = F.when(i == j, F.slice(swapped, 1, 1)).otherwise(swapped)
    return stored.select(F.explode(both).alias("x")).select("x.*")


def desymmetrize(t: Tensor, kind: str | None = None, a: int = 0, b: int = 1) -> Tensor:
    """All entries of a packed tensor; with a kind, of a tensor whose rows are those of one."""
    if kind is None:
        return t._with(t.df)
    _kind(kind)
    return t._with(_packed(t, t.stored, kind, a, b).df)


def recast(t: Tensor, kind: str, a: int = 0, b: int = 1) -> Tensor:
    """A copy under another symmetry: unpacked, then the half that the new kind stores; what it can't hold (a lower half that differs, a diagonal) is left out."""
    return pack(desymmetrize(t), kind, a, b)


def contract(notation: str, *operands: Tensor, kind: str, a: int = 0, b: int = 1, symmetrized: bool = True) -> Tensor:
    """A contraction with a packed result: symmetrized (summed over both orders of two modes, with their sign), or the half of a result that has the symmetry already."""
    result = einsum(notation, *operands)
    return symmetrize(result, kind, a, b) if symmetrized else pack(result, kind, a, b)


def product(x: Tensor, y: Tensor) -> Tensor:
    """The symmetric product A B + B A of symmetric matrices, packed, from one product C = A B: as A B and B A are each other's transposes, C + C^T is enough."""
    c = einsum("ij,jk->ik", x, y)
    whole = (c + c.T)
    return pack(whole, "SY")


def symmetrize(t: Tensor, kind: str, a: int = 0, b: int = 1) -> Tensor:
    """Packed sum of a tensor and its transpose in two modes (AS: their difference); the diagonal is taken once for SY and dropped else."""
    _kind(kind)
    if kind == "NS":
        return t
    i, j = F.col(f"i{a}"), F.col(f"i{b}")
    upper = t.df.where(i <= j if kind == "SY" else i < j)
    lower = t.df.where(i > j).select(*_swapped(t, a, b))
    if kind == "AS":
        lower = lower.withColumn("v", types.negative(V(), t.dtype))
    return _packed(t, upper.unionByName(lower).groupBy(*t.keys).agg(t.algebra.plus(V()).alias("v")), kind, a, b)


def scale_diagonal(t: Tensor, s, a: int = 0, b: int = 1) -> Tensor:
    """Entries with i_a = i_b times s; 0 takes them out."""
    i, j = F.col(f"i{a}"), F.col(f"i{b}")
    if s == 0:
        return t._with(t.df.where(i != j))
    return t._with(t.df.withColumn("v", F.when(i == j, types.multiply(V(), types.literal(s, t.dtype), t.dtype)).otherwise(V())))


def aligned(t: Tensor, kind: str, a: int = 0, b: int = 1) -> Tensor:
    """Entries written at any order of two modes brought to the stored order, with their sign; equal places are summed."""
    _kind(kind)
    i, j = F.col(f"i{a}"), F.col(f"i{b}")
    sign = F.when(i > j, types.negative(V(), t.dtype)).otherwise(V()) if kind == "AS" else V()
    rows = t.stored if kind == "SY" else t.stored.where(i != j)
    moved = rows.select(*(F.least(i, j).alias(f"i{k}") if k == a else F.greatest(i, j).alias(f"i{k}") if k == b else F.col(f"i{k}") for k in range(t.ndim)), sign.alias("v"))
    return _packed(t, moved.groupBy(*t.keys).agg(t.algebra.plus(V()).alias("v")), kind, a, b)


def packed_size(n: int, kind: str) -> int:
    return {"NS": n * n, "SY": n * (n + 1) // 2}.get(kind, n * (n - 1) // 2)
