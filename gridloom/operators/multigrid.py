"""Algebraic multigrid for sparse symmetric matrices, set up from the matrix alone, with every level a relation.

Strong connections of a matrix make a graph. Aggregates grow around the vertices of a maximal set that is more than two edges apart: each vertex joins the
root it is next to, and those left over an aggregate of a neighbour. A damped Jacobi step smooths the aggregates' indicator columns into a prolongator,
the coarse matrix is P^T A P, and so on until a level is small. A cycle smooths, hands the residual down, and takes the correction back up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from . import graphs
from .tensor import V, Tensor, einsum
from .workloads import galerkin, v_cycle

#: Unknowns of a level that the driver solves.
COARSE = 256


def _written(t: Tensor) -> Tensor:
    return t._with(checkpointed(t.df))


def strength(a: Tensor, threshold: float = 0.08) -> Tensor:
    """Entries off the diagonal with |a_ij| of at least threshold times sqrt(|a_ii a_jj|): 1 where rows are strongly connected."""
    diagonal = a.df.where("i0 = i1").select("i0", F.abs(V()).alias("d"))
    rows = a.df.where("i0 != i1 and v != 0").join(diagonal, "i0").join(diagonal.toDF("i1", "e"), "i1")
    kept = rows.where(F.abs(V()) >= threshold * F.sqrt(F.col("d") * F.col("e")))
    return Tensor(kept.select("i0", "i1", F.lit(1.0).alias("v")), a.shape)


def connected(a: Tensor, threshold: float = 0.08) -> float:
    """A threshold of strength at which aggregates grow: the given one if half of the rows with connections have a strong one there, else a quarter of the median of the rows' strongest.

    Rows with many connections have none that is large beside the diagonal; without a lower threshold their vertices stay by themselves, and levels hardly get smaller.
    """
    diagonal = a.df.where("i0 = i1").select("i0", F.abs(V()).alias("d"))
    rows = a.df.where("i0 != i1 and v != 0").join(diagonal, "i0").join(diagonal.toDF("i1", "e"), "i1")
    strongest = rows.groupBy("i0").agg(F.max(F.abs(V()) / F.sqrt(F.col("d") * F.col("e"))).alias("x"))
    median = strongest.agg(F.percentile_approx("x", 0.5)).first()[0]
    return threshold if median is None or median >= threshold else median / 4


def aggregates(strong: Tensor, seed: int = 0) -> Tensor:
    """(vertex, aggregate) with 1 where a vertex belongs: each to one aggregate, numbered from 0 in order of roots. Vertices without strong connections are aggregates by themselves."""
    n, spark = strong.shape[0], strong.spark
    roots = graphs.independent_set(strong, 2, seed).df.select(F.col("i0").alias("i"))
    edges = checkpointed(graphs._symmetric(strong).select(F.col("i0").alias("i"), F.col("i1").alias("j")))
    of = checkpointed(roots.select("i", F.col("i").alias("root")))
    every = spark.range(n).select(F.col("id").alias("i"))
    # Neighbours of a root, then neighbours of those: within two edges of the set lies every vertex.
    for _ in range(2):
        left = every.join(of, "i", "left_anti")
        near = left.join(edges, "i").join(of.select(F.col("i").alias("j"), "root"), "j").groupBy("i").agg(F.min("root").alias("root"))
        of = checkpointed(of.unionByName(near))
    # Numbers of roots, block by block, so that no window has all of them.
    block = F.expr("root div 65536")
    numbered = roots.toDF("root").withColumn("block", block)
    sizes = sorted((r["block"], r["count"]) for r in numbered.groupBy("block").count().collect())
    starts, at = [], 0
    for b, count in sizes:
        starts.append((b, at))
        at += count
    number = F.row_number().over(W.partitionBy("block").orderBy("root")) - 1 + F.col("start")
    numbers = numbered.join(spark.createDataFrame(starts, "block bigint, start bigint"), "block").select("root", number.cast("bigint").alias("i1"))
    rows = of.join(numbers, "root").select(F.col("i").alias("i0"), "i1", F.lit(1.0).alias("v"))
    return Tensor(rows, (n, at))


def prolongator(a: Tensor, tentative: Tensor, weight: float = 2 / 3) -> Tensor:
    """A damped Jacobi step on the aggregates' columns: T - weight D^-1 A T."""
    step = einsum("ij,ja->ia", a, tentative)
    diagonal = a.df.where("i0 = i1").select("i0", V().alias("d"))
    scaled = step._with(step.df.join(diagonal, "i0").select("i0", "i1", (V() * (-weight) / F.col("d")).alias("v")))
    return (tentative + scaled).sparsify()


@dataclass
class Hierarchy:
    """Matrices from fine to coarse, and prolongators from each coarser level to the finer one."""

    levels: list[Tensor]
    prolong: list[Tensor]

    @classmethod
    def of(cls, a: Tensor, coarse: int = COARSE, threshold: float = 0.08, most: int = 20) -> Hierarchy:
        """The levels of a matrix, until one has at most `coarse` unknowns or doesn't get smaller."""
        levels, prolong = [_written(a)], []
        while levels[-1].shape[0] > coarse and len(levels) < most:
            fine = levels[-1]
            t = _written(aggregates(_written(strength(fine, connected(fine, threshold)))))
            if t.shape[1] >= fine.shape[0]:
                break
            p = _written(prolongator(fine, t))
            levels.append(_written(galerkin(fine, p).sparsify()))
            prolong.append(p)
        if levels[-1].shape[0] > 4096:
            raise ArithmeticError(f"the coarsest level has {levels[-1].shape[0]} unknowns: strong connections are too few at threshold {threshold}")
        return cls(levels, prolong)

    def cycle(self, b: Tensor, x: Tensor, rounds: int = 2) -> Tensor:
        return v_cycle(self.levels, self.prolong, b, x, rounds) if self.prolong else self.direct(b)

    def direct(self, b: Tensor) -> Tensor:
        a = self.levels[-1]
        return Tensor.from_numpy(a.spark, np.linalg.lstsq(a.to_numpy(), b.to_numpy(), rcond=None)[0])

    def solve(self, b: Tensor, tolerance: float = 1e-8, cycles: int = 60, rounds: int = 2) -> Tensor:
        """x with |b - A x| at most tolerance times |b|."""
        a, scale = self.levels[0], b.norm2() or 1.0
        x = b * 0.0
        left = scale
        for _ in range(cycles):
            x = _written(self.cycle(b, x, rounds))
            left = (b - einsum("ij,j->i", a, x)).norm2()
            if left <= tolerance * scale:
                return x
        raise ArithmeticError(f"a residual of {left / scale:.2g} after {cycles} cycles")


def laplacian(weights: Tensor, shift: float = 0.0) -> Tensor:
    """D - W of a symmetric graph's weights, and shift on the diagonal, which makes it definite. Loops don't count."""
    n = weights.shape[0]
    edges = weights.df.where("i0 != i1").select("i0", "i1", V().cast("double").alias("v"))
    both = edges.unionByName(edges.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")).groupBy("i0", "i1").agg(F.max("v").alias("v"))
    both = checkpointed(both)
    degree = both.groupBy("i0").agg(F.sum("v").alias("v")).select("i0", F.col("i0").alias("i1"), "v")
    loops = weights.spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(shift).alias("v"))
    rows = both.select("i0", "i1", (-V()).alias("v")).unionByName(degree).unionByName(loops).groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    return Tensor(rows, (n, n))
