"""Index notation: labelled tensors, products, sums and functions of them, and what is done with the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import types
from ..functions.algebras import Algebra
from ..plans import planner
from .tensor import V, Tensor, einsum


class Term:
    """A sum of products; each product has a scale and labelled tensors."""

    def products(self) -> list[Product]:
        raise NotImplementedError

    def __mul__(self, x) -> Term:
        if not isinstance(x, Term):
            return Sum([Product(p.factors, p.scale * x) for p in self.products()])
        return Sum([Product([*p.factors, *q.factors], p.scale * q.scale) for p in self.products() for q in x.products()])

    __rmul__ = __mul__

    def __add__(self, x: Term) -> Term:
        return Sum([*self.products(), *x.products()])

    def __sub__(self, x: Term) -> Term:
        return self + x * -1

    def __neg__(self) -> Term:
        return self * -1

    def scaled(self, s) -> Term:
        return self * s

    def sizes(self) -> dict[str, int]:
        return {c: n for p in self.products() for t, labels in p.factors for c, n in zip(labels, t.shape)}

    def to(self, labels: str, sizes: dict[str, int] | None = None, algebra: Algebra | None = None) -> Tensor:
        """The value under some labels; a label that no factor of a product has is repeated over its length."""
        lengths = {**self.sizes(), **(sizes or {})}
        parts = []
        for p in self.products():
            notation = ",".join(x for _, x in p.factors) + "->" + labels
            part = einsum(notation, *(t for t, _ in p.factors), algebra=algebra, sizes=lengths)
            parts.append(part if p.scale == 1 else part * p.scale)
        if len(parts) == 1:
            return parts[0]
        dtype = types.promote(*(p.dtype for p in parts))
        rows = reduce(lambda a, b: a.unionByName(b), [p.astype(dtype).df if algebra is None else p.df for p in parts])
        total = (algebra or parts[0].astype(dtype).algebra).plus
        df = rows.groupBy(*parts[0].keys).agg(total(V()).alias("v"))
        return Tensor(df, parts[0].shape, dtype, algebra, all(p.sparse for p in parts), sum(p.rows for p in parts))

    def value(self):
        """The sum over all labels."""
        return self.to("").item()

    def estimate(self) -> float:
        """Rows that the planner expects to join."""
        total = 0.0
        for p in self.products():
            known = [t.leaf(x) for t, x in p.factors]
            leaves = [(frozenset(x.labels), x.rows) for x in known]
            sizes = self.sizes()
            live = dict(enumerate((*own, x.shares) for own, x in zip(leaves, known)))
            for n, (a, b) in enumerate(planner.order(leaves, set(), sizes, [x.shares for x in known])):
                x, y = live.pop(a), live.pop(b)
                keep = set().union(*(z[0] for z in live.values()))
                joined, kept, shares = planner.estimate(x[:2], y[:2], keep, sizes, x[2], y[2])
                total += joined
                live[len(leaves) + n] = ((x[0] | y[0]) & keep, kept, shares)
        return total


@dataclass
class Product(Term):
    factors: list[tuple[Tensor, str]]
    scale: complex | float | int = 1

    def products(self) -> list[Product]:
        return [self]


@dataclass
class Sum(Term):
    parts: list[Product] = field(default_factory=list)

    def products(self) -> list[Product]:
        return self.parts


class Indexed(Term):
    """A tensor under labels: a factor of a term, or the target of one. Targets give a new tensor."""

    def __init__(self, tensor: Tensor, labels: str):
        if len(labels) != tensor.ndim:
            raise ValueError(f"labels {labels!r} for {tensor.ndim} dimensions")
        self.tensor, self.labels = tensor, labels

    def products(self) -> list[Product]:
        return [Product([(self.tensor, self.labels)])]

    def _selected(self) -> Column:
        """Rows that repeated labels select."""
        first: dict[str, int] = {}
        out = F.lit(True)
        for k, c in enumerate(self.labels):
            if c in first:
                out = out & (F.col(f"i{first[c]}") == F.col(f"i{k}"))
            first.setdefault(c, k)
        return out

    def _evaluated(self, term: Term) -> Tensor:
        t = self.tensor
        result = term.to(self.labels, dict(zip(self.labels, t.shape)), None if t.algebra.name.startswith("ring") else t.algebra)
        return result.astype(t.dtype) if result.dtype != t.dtype else result

    def assign(self, term: Term) -> Tensor:
        """=: selected places take the term's value, zero where it has none."""
        rest = self.tensor.df.where(~self._selected())
        return self.tensor._with(rest.unionByName(self._evaluated(term).df))

    def accumulate(self, term: Term, beta=1) -> Tensor:
        """+=: beta times the selected entries plus the term."""
        t = self.tensor
        chosen = self._selected()
        old = t.df if beta == 1 else t.df.withColumn("v", F.when(chosen, types.multiply(V(), types.literal(beta, t.dtype), t.dtype)).otherwise(V()))
        df = old.unionByName(self._evaluated(term).df).groupBy(*t.keys).agg(t.algebra.plus(V()).alias("v"))
        return t._with(df if types.is_complex(t.dtype) else df.withColumn("v", V().cast(types.SQL[t.dtype])))

    def subtract(self, term: Term) -> Tensor:
        return self.accumulate(term * -1)

    def multiply(self, term: Term) -> Tensor:
        """*=: the product with the term under the same labels."""
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("labels of a product's target must differ")
        return self.tensor * self._evaluated(term)

    def scale(self, s) -> Tensor:
        """Selected entries times a scalar."""
        t = self.tensor
        scaled = types.multiply(V(), types.literal(s, t.dtype), t.dtype)
        return t._with(t.df.withColumn("v", F.when(self._selected(), scaled if types.is_complex(t.dtype) else scaled.cast(types.SQL[t.dtype])).otherwise(V())))

    def fill(self, value) -> Tensor:
        """Selected places take a scalar."""
        t = self.tensor
        distinct = list(dict.fromkeys(self.labels))
        length = dict(zip(self.labels, t.shape))
        places = Tensor.full(t.spark, [length[c] for c in distinct], value, t.dtype).df
        rows = places.select(*(F.col(f"i{distinct.index(c)}").alias(f"k{k}") for k, c in enumerate(self.labels)), "v").toDF(*t.keys, "v")
        return t._with(t.df.where(~self._selected()).unionByName(rows))

    def transform(self, f: Callable[[Column], Column]) -> Tensor:
        """f in place of each selected stored value."""
        return self.tensor._with(self.tensor.df.withColumn("v", F.when(self._selected(), f(V())).otherwise(V())))

    def svd(self, left: str, right: str, rank: int | None = None, threshold: float | None = None, random: bool = False):
        from . import multilinear

        return multilinear.tensor_svd(self, left, right, rank, threshold, random)


def vectorised(f: Callable, dtype: str = "float64") -> Callable[..., Column]:
    """A function of NumPy arrays as one of columns, for functions that columns can't express: applied to Arrow batches of values."""

    @F.pandas_udf(types.SQL[dtype])
    def applied(*columns: pd.Series) -> pd.Series:
        return pd.Series(f(*(c.to_numpy() for c in columns)))

    return applied


def function(f: Callable[[Column], Column], source: Indexed, labels: str, dtype: str | None = None, algebra: Algebra | None = None) -> Tensor:
    """f of each stored value, added up under the target's labels."""
    mapped = source.tensor.map(f, dtype)
    return einsum(f"{source.labels}->{labels}", mapped, algebra=algebra or mapped.algebra, distributive=True)


def function2(f: Callable[[Column, Column], Column], a: Indexed, b: Indexed, labels: str, dtype: str | None = None, algebra: Algebra | None = None, intersect_only: bool = True, distributive: bool = False) -> Tensor:
    """f of two values that meet on shared labels, added up. Without intersect_only both are filled in first. Sums move before the join only where f is declared distributive."""
    x, y = (a.tensor, b.tensor) if intersect_only else (a.tensor.densify(), b.tensor.densify())
    dtype = dtype or types.promote(x.dtype, y.dtype)
    lengths = {**dict(zip(a.labels, x.shape)), **dict(zip(b.labels, y.shape))}
    from ..functions.algebras import ring

    df = planner.contract([x.leaf(a.labels), y.leaf(b.labels)], labels, lengths, algebra or ring(dtype), f, distributive)
    return Tensor(df, [lengths[c] for c in labels], dtype, algebra)


def transform2(f: Callable[[Column, Column], Column], a: Indexed, b: Indexed) -> Tensor:
    """f(a, b) in place of each stored b that meets an a; a's labels must be among b's, so one a meets each b."""
    if not set(a.labels) <= set(b.labels):
        raise ValueError("every label of what is read must be one of what is changed")
    keys = [f"i{b.labels.index(c)}" for c in a.labels]
    other = a.tensor.df.select(*(F.col(f"i{k}").alias(n) for k, n in enumerate(keys)), V().alias("a"))
    joined = b.tensor.df.join(other, keys, "left")
    return b.tensor._with(joined.select(*b.tensor.keys, F.when(F.col("a").isNotNull(), f(F.col("a"), V())).otherwise(V()).alias("v")))


def transform3(f: Callable[[Column, Column, Column], Column], a: Indexed, b: Indexed, c: Indexed) -> Tensor:
    """f(a, b, c) in place of each stored c that meets an a and a b."""
    out = c.tensor.df
    for name, x in (("a", a), ("b", b)):
        if not set(x.labels) <= set(c.labels):
            raise ValueError("every label of what is read must be one of what is changed")
        keys = [f"i{c.labels.index(k)}" for k in x.labels]
        out = out.join(x.tensor.df.select(*(F.col(f"i{k}").alias(n) for k, n in enumerate(keys)), V().alias(name)), keys, "left")
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    return c.tensor._with(out.select(*c.tensor.keys, F.when(met, f(F.col("a"), F.col("b"), V())).otherwise(V()).alias("v")))


def contract(alpha, a: Indexed, b: Indexed, beta, c: Indexed, f: Callable[[Column, Column], Column] | None = None) -> Tensor:
    """beta times c plus alpha times the contraction of a and b under c's labels; f in place of the product, which a sum can then not be moved before."""
    t = c.tensor
    lengths = dict(zip(c.labels, t.shape))
    part = function2(f, a, b, c.labels, t.dtype, t.algebra) if f else (a * b).to(c.labels, lengths)
    part = part if alpha == 1 else part * alpha
    return c.accumulate(part.i(c.labels), beta)
