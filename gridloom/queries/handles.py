"""Queries on handles: building, reading and writing tensors, reductions through the handle, structure, symmetry, storage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.algebras import PAIRS, Algebra, monoid, ring
from ..operators import symmetry
from ..operators.notation import contract, transform3, vectorised
from ..operators.profile import FlopCounter, Profile, Schedule, Timer, TimerEpoch, World
from ..operators.tensor import Tensor, einsum, hstack, stack
from ..operators.typed import Matrix, Scalar, Seeds, Vector
from ..sources import files
from ..sources.checkpoint import checkpointed, shared_folder
from .registry import CELLS, NATIONS, REGIONS, one, query, regions, rows
from .tables import Tables

SAME = f"WITH {NATIONS}, {CELLS} SELECT n, m, round(v, 4) AS v FROM cells"


# Sources and sinks


@query(SAME)
def dense_binary(t: Tables):
    """Written as raw values and read back."""
    path = f"{shared_folder(t.spark)}/dense-{uuid.uuid4().hex}"
    files.write_binary(t.nations(), path, block=100)
    return rows(files.read_binary(t.spark, path, (25, 25)), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def checkpoint_sparse(t: Tables):
    path = f"{shared_folder(t.spark)}/saved-{uuid.uuid4().hex}"
    files.save(t.nations(), path)
    return rows(files.restore(t.spark, path, (25, 25), sparse=True), "nm")


@query(SAME)
def checkpoint_dense(t: Tables):
    path = f"{shared_folder(t.spark)}/saved-{uuid.uuid4().hex}"
    files.save(t.nations().densify(), path)
    return rows(files.restore(t.spark, path, (25, 25)), "nm")


@query(SAME)
def array_round_trip(t: Tables):
    return rows(Tensor.from_numpy(t.spark, t.nations().to_numpy()), "nm")


@query(f"WITH {NATIONS}, {CELLS} SELECT n, m, round(CASE WHEN n * 25 + m IN (0, 30, 624) THEN 2 * v + 3 * (n + m) ELSE v END, 4) AS v FROM cells")
def point_write_scaled(t: Tables):
    """3 times given values and 2 times what was there, at linear places."""
    w = t.nations().densify()
    return rows(w.write([0, 30, 624], [0.0, 6.0, 48.0], alpha=3, beta=2), "nm")


@query(f"WITH {NATIONS} SELECT x.n::BIGINT AS n, x.m::BIGINT AS m, round(10.0 * x.k + 2 * coalesce(w.v, 0), 4) AS v FROM (VALUES (0, 0, 1), (3, 4, 2), (24, 24, 3)) x(n, m, k) LEFT JOIN w ON w.n = x.n AND w.m = x.m")
def point_read_scaled(t: Tables):
    got = t.nations().densify().read([(0, 0), (3, 4), (24, 24)], [1.0, 2.0, 3.0], alpha=2, beta=10)
    return got.select(F.col("i0").alias("n"), F.col("i1").alias("m"), F.round("v", 4).alias("v"))


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w WHERE v <> 0")
def local_pairs(t: Tables):
    return t.nations().local(nonzero=True).select(F.col("i0").alias("n"), F.col("i1").alias("m"), F.round("v", 4).alias("v"))


@query(f"WITH {NATIONS} SELECT n * 25 + m AS at, round(v, 4) AS v FROM w")
def global_pairs(t: Tables):
    return t.spark.createDataFrame([(k, round(v, 4)) for k, v in t.nations().pairs()], "at long, v double")


@query(f"WITH {NATIONS}, {CELLS} SELECT a.n, a.m, round(a.v, 4) AS a, round(b.v, 4) AS b FROM cells a JOIN cells b ON a.n = b.m AND a.m = b.n WHERE abs(a.v - b.v) > 10")
def compare_tensors(t: Tables):
    w = t.nations()
    return w.compare(w.T, 10.0).select(F.col("i0").alias("n"), F.col("i1").alias("m"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"WITH {NATIONS} SELECT ((n // 4) % 2) AS p, ((m // 3) % 3) AS q, (n // 8) * 4 + n % 4 AS i, (m // 9) * 3 + m % 3 AS j, round(v, 4) AS v FROM w")
def block_cyclic(t: Tables):
    return files.to_block_cyclic(t.nations(), (4, 3), (2, 3)).select("p", "q", "i", "j", F.round("v", 4).alias("v"))


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def block_cyclic_round_trip(t: Tables):
    w = t.nations()
    return rows(files.from_block_cyclic(files.to_block_cyclic(w, (4, 3), (2, 3)), w.shape, (4, 3), (2, 3)), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def csr_round_trip(t: Tables):
    w = t.nations()
    return rows(files.from_csr(files.to_csr(w), w.shape), "nm")


@query(f"WITH {NATIONS} SELECT a.n AS n, b.m AS m, round(sum(a.v * b.v), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def csr_times_dense(t: Tables):
    w = t.nations()
    return rows(files.csr_times_dense(files.to_csr(w), w.densify(), 25).sparsify(), "nm", 2)


# Building


@query("""SELECT 'zeros' AS what, i AS n, j AS m, 0.0::DOUBLE AS v FROM range(3) a(i), range(4) b(j) UNION ALL SELECT 'ones', i, j, 1.0 FROM range(3) a(i), range(4) b(j) UNION ALL SELECT 'eye', i, i + 1, 1.0 FROM range(3) a(i)
UNION ALL SELECT 'range', i, 0, 2.0 + i * 0.5 FROM range(6) a(i) UNION ALL SELECT 'all', i, j, 7.0 FROM range(3) a(i), range(4) b(j) UNION ALL SELECT 'like', i, j, 0.0 FROM range(3) a(i), range(4) b(j)""")
def constructors(t: Tables):
    ones = Tensor.ones(t.spark, (3, 4))
    made = {"zeros": Tensor.zeros(t.spark, (3, 4)).densify(), "ones": ones, "eye": Tensor.eye(t.spark, 3, 4, 1), "range": Tensor.arange(t.spark, 2.0, 5.0, 0.5).reshape(6, 1), "all": ones.set_all(7.0), "like": ones.zeros_like().densify()}
    out = None
    for name, x in made.items():
        part = rows(x, "nm").select(F.lit(name).alias("what"), "n", "m", "v")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 1000::BIGINT AS n, true AS within, true AS again, true AS other, true AS sparse, true AS sampled")
def random_tensors(t: Tables):
    """Bounds, the same values for the same seed, others for another, and how many places a sparse one and a sample keep."""
    seeds = Seeds(3)
    x, y = Tensor.random(t.spark, (40, 25), -1, 2, seed=5), Tensor.random(t.spark, (40, 25), -1, 2, seed=seeds.next())
    f = x.figures("min", "max").first()
    few, some = Tensor.random(t.spark, (40, 25), seed=6, fraction=0.2).nnz(), x.sample(0.5, 3)
    kept = some.df.join(x.df, ["i0", "i1", "v"], "left_semi").count()
    return one(t.spark, n=x.df.count(), within=f["min"] >= -1 and f["max"] < 2, again=(x - Tensor.random(t.spark, (40, 25), -1, 2, seed=5)).norm_inf() == 0, other=(x - y).norm_inf() > 0, sparse=100 < few < 300, sampled=kept == some.df.count() and 400 < kept < 600)


@query(f"WITH {NATIONS} SELECT 2::BIGINT AS ndim, 625::BIGINT AS size, 8::BIGINT AS itemsize, 5000::BIGINT AS nbytes, 200::BIGINT AS stride, 0::BIGINT AS zeroed, round(sum(v), 2) AS total, true AS truth, 25::BIGINT AS length FROM w")
def handle(t: Tables):
    w = t.nations()
    total = Scalar(w.copy().sum())
    length = Vector(w[0]).length + 0 * Matrix(w).rows_columns[0]
    return one(t.spark, ndim=w.ndim, size=w.size, itemsize=w.itemsize, nbytes=w.nbytes, stride=w.strides[0], zeroed=w.set_zero().nnz(), total=round(float(total.get()), 2), truth=bool(total) and int(total.set(3.0)) == 3, length=length)


# Notation


@query(f"WITH {NATIONS}, d AS (SELECT n, sum(v) AS v FROM w GROUP BY ALL) SELECT n, m, round(v, 4) AS v FROM w WHERE n <> m UNION ALL SELECT n, n, round(v, 4) FROM d")
def assign_labels(t: Tables):
    w = t.nations()
    return rows(w.i("nn").assign(w.sum(axis=1).i("n")), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) + 0.0 AS v FROM (SELECT n, m, v FROM w UNION ALL SELECT m, n, -0.25 * v FROM w) GROUP BY ALL")
def subtract_labels(t: Tables):
    w = t.nations()
    return rows(w.i("nm").subtract(w.i("mn") * 0.25), "nm")


@query(f"WITH {NATIONS}, d AS (SELECT n, sum(v) AS v FROM w GROUP BY ALL) SELECT w.n, m, round(w.v * d.v, 2) AS v FROM w JOIN d ON w.n = d.n")
def multiply_labels(t: Tables):
    w = t.nations()
    return rows(w.i("nm").multiply(w.sum(axis=1).i("n")), "nm", 2)


@query(f"WITH {NATIONS} SELECT round(sum(v * v), 0) AS v FROM w")
def scalar_value(t: Tables):
    w = t.nations()
    return one(t.spark, v=float(round((w.i("nm") * w.i("nm")).value(), 0)))


@query(f"WITH {NATIONS}, p AS (SELECT a.n AS n, b.m AS m, sum(abs(a.v - b.v)) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL) SELECT n, m, round(sum(v), 2) AS v FROM (SELECT n, m, 0.5 * v AS v FROM p UNION ALL SELECT n, m, 2 * v FROM w) GROUP BY ALL")
def contract_bivariate(t: Tables):
    w = t.nations()
    return rows(contract(0.5, w.i("nk"), w.i("km"), 2, w.i("nm"), lambda a, b: F.abs(a - b)), "nm", 2)


@query(f"WITH {NATIONS} SELECT n, m, round(v * (n + m), 4) AS v FROM w")
def promoted_product(t: Tables):
    """Integers times doubles."""
    places = Tensor(t.spark.range(625).select(F.expr("id div 25").alias("i0"), F.expr("id % 25").alias("i1"), F.expr("cast(id div 25 + id % 25 as int)").alias("v")), (25, 25), "int32")
    return rows(einsum("nm,nm->nm", t.nations(), places), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(CASE WHEN n = m THEN sqrt(v) ELSE v END, 4) AS v FROM w")
def transform_selected(t: Tables):
    return rows(t.nations().i("nn").transform(F.sqrt), "nm")


@query(f"WITH {NATIONS}, d AS (SELECT n, v FROM w WHERE n = m) SELECT w.n, w.m, round(CASE WHEN a.v IS NULL OR b.v IS NULL THEN w.v ELSE w.v / sqrt(a.v * b.v) END, 6) AS v FROM w LEFT JOIN d a ON w.n = a.n LEFT JOIN d b ON w.m = b.n")
def transform_by_two(t: Tables):
    w = t.nations()
    d = w.diagonal()
    return rows(transform3(lambda a, b, c: c / F.sqrt(a * b), d.i("n"), d.i("m"), w.i("nm")), "nm", 6)


# Elementwise and reductions


@query("SELECT l_linenumber::BIGINT AS i, round(sum(l_quantity), 4) AS re, round(-sum(l_tax), 4) AS im, round(sum(l_quantity), 4) AS re_of, 7.0::DOUBLE AS im_set FROM lineitem GROUP BY ALL")
def complex_parts(t: Tables):
    """Conjugate, real part, and another imaginary part, of sums by line number."""
    n = t.length("lineitem", "l_linenumber")
    x = Tensor.from_df(t.read("lineitem"), ["l_linenumber"], F.struct(F.col("l_quantity").alias("re"), F.col("l_tax").alias("im")), (n,), "complex128")
    c, r = x.conj(), x.real()
    out = c.df.select("i0", F.round("v.re", 4).alias("re"), F.round("v.im", 4).alias("im")).join(r.df.select("i0", F.round("v", 4).alias("re_of")), "i0")
    changed = x.imag(Tensor.full(t.spark, (n,), 7.0)).df.select("i0", F.col("v.im").alias("im_set"))
    return out.join(changed, "i0").withColumnRenamed("i0", "i")


@query(f"WITH {NATIONS}, {CELLS} SELECT bool_and(v <> 0) AS every, bool_or(v <> 0) AS some, round(sum(v), 2) AS norm1, round(sqrt(sum(v * v)), 2) AS norm2, max(v) AS norm_inf, min(v) AS min_abs, round(sum(v * v), 0) AS sumsq FROM cells")
def vector_norms(t: Tables):
    w = t.nations()
    x = w.ravel()
    x = x._with(checkpointed(x.df))
    return one(t.spark, every=bool(x.all()), some=bool(x.any()), norm1=round(x.vecnorm(1), 2), norm2=round(x.vecnorm(2), 2), norm_inf=x.vecnorm(np.inf), min_abs=x.min_abs(), sumsq=float(round(x.sumsq(), 0)))


@query("SELECT true AS same")
def spectral_norm(t: Tables):
    """The largest singular value is the root of the Gram matrix's largest eigenvalue."""
    from ..operators import linalg

    w = t.nations()
    d, _ = linalg.eigh(einsum("nm,nk->mk", w, w))
    return one(t.spark, same=bool(abs(w.norm(2) - d[-1] ** 0.5) < 1e-6 * w.norm(2)))


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w WHERE v % 2 = 0")
def sparsify_where(t: Tables):
    return rows(t.nations().sparsify(keep=lambda v: v % 2 == 0), "nm")


# Structure


@query(f"WITH {NATIONS} SELECT n * 25 + m AS i, round(v, 4) AS v FROM w")
def ravel(t: Tables):
    return rows(t.nations().ravel(), "i")


@query(f"WITH {NATIONS} SELECT n - 2 AS n, m - 3 AS m, round(v, 4) AS v FROM w WHERE n BETWEEN 2 AND 9 AND m BETWEEN 3 AND 20")
def slice_corners(t: Tables):
    """The box between two row-major places."""
    return rows(t.nations().slice(2 * 25 + 3, 9 * 25 + 20), "nm")


@query(f"WITH {NATIONS}, {CELLS} SELECT n, m, round(CASE WHEN n < 3 AND m < 3 THEN 2 * v + 3 * (n * 3 + m) ELSE v END, 4) AS v FROM cells")
def slice_accumulate(t: Tables):
    w = t.nations().densify()
    return rows(w.add_slice((0, 0), (3, 3), Tensor.from_numpy(t.spark, np.arange(9.0).reshape(3, 3)), 2.0, 3.0), "nm")


@query(f"WITH {NATIONS}, s AS (SELECT n, sum(v) AS v FROM w GROUP BY ALL) SELECT n, n + 2 AS m, round(v, 4) AS v FROM s")
def diagonal_matrix(t: Tables):
    return rows(t.nations().sum(axis=1).diag(2), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w UNION ALL SELECT n, m + 25, round(v, 4) FROM w")
def hstack_nations(t: Tables):
    w = t.nations()
    return rows(hstack([w, w]), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def batches(t: Tables):
    """Slices along the last mode and together again."""
    return rows(Tensor.from_batches(t.nations().batches()), "nm")


@query(f"WITH {NATIONS} SELECT 24 - n AS n, m - 5 AS m, round(v, 4) AS v FROM w WHERE m BETWEEN 5 AND 14")
def permuted_slice(t: Tables):
    return rows(t.nations().permute([list(range(24, -1, -1)), None])[:, 5:15], "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) AS v FROM (SELECT n, m, 2 * v AS v FROM w UNION ALL SELECT m, n, 3 * v FROM w) GROUP BY ALL")
def add_from(t: Tables):
    w = t.nations()
    return rows(w.add_from(w.T, 3.0, 2.0), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def aligned_partitions(t: Tables):
    """Partitioned by a mode, another tensor alike."""
    w = t.nations()
    return rows(w.align(w.T.distributed(3, 0)), "nm")


@query(f"WITH {NATIONS} SELECT n, 1::BIGINT AS parts, round(sum(v), 4) AS v FROM w GROUP BY ALL")
def mapped_read(t: Tables):
    """Under a partitioning by nation each nation's rows are in one partition."""
    held = t.nations().mapped(4, 0)
    return held.groupBy(F.col("i0").alias("n")).agg(F.count_distinct("partition").alias("parts"), F.round(F.sum("v"), 4).alias("v"))


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def mapped_round_trip(t: Tables):
    return rows(Tensor.from_mapped(t.nations().mapped(3, 1), (25, 25)), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w")
def split_and_stacked(t: Tables):
    return rows(stack(t.nations().split(4, 1), 1), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(ln(1 + v), 6) AS v FROM w")
def vectorised_function(t: Tables):
    """A NumPy function of the values."""
    return rows(t.nations().map(vectorised(np.log1p)), "nm", 6)


# Symmetry


@query(f"WITH {NATIONS}, p AS (SELECT least(n, m) AS n, greatest(n, m) AS m, sum(v) AS v FROM w GROUP BY ALL), f AS (SELECT n, m, v FROM p UNION ALL SELECT m, n, v FROM p WHERE n <> m) SELECT n, round(sum(v * (1 + m)), 4) AS v FROM f GROUP BY ALL")
def packed_matvec(t: Tables):
    """A packed matrix stands for all its entries."""
    packed = symmetry.symmetrize(t.nations(), "SY")
    return rows(einsum("nm,m->n", packed, Tensor.arange(t.spark, 1.0, 26.0)), "n")


@query(f"WITH {NATIONS}, p AS (SELECT a.n AS n, b.m AS m, sum(a.v * b.v) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL) SELECT least(n, m) AS n, greatest(n, m) AS m, round(sum(CASE WHEN n > m THEN -v ELSE v END), 2) + 0.0 AS v FROM p WHERE n <> m GROUP BY ALL")
def packed_contraction(t: Tables):
    w = t.nations()
    out = symmetry.contract("nk,km->nm", w, w, kind="AS")
    return out.stored.select(F.col("i0").alias("n"), F.col("i1").alias("m"), (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query(f"WITH {NATIONS}, s AS (SELECT n, m, sum(v) AS v FROM (SELECT n, m, v FROM w UNION ALL SELECT m, n, v FROM w) GROUP BY ALL), p AS (SELECT a.n AS n, b.m AS m, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.m = b.n GROUP BY ALL) SELECT n, m, round(2 * v, 2) AS v FROM p")
def symmetric_product(t: Tables):
    w = t.nations()
    s = w + w.T
    s = s._with(checkpointed(s.df))
    return rows(symmetry.product(s, s), "nm", 2)


@query(f"WITH {NATIONS} SELECT least(n, m) AS n, greatest(n, m) AS m, round(sum(v), 4) AS v FROM w GROUP BY ALL")
def aligned_entries(t: Tables):
    out = symmetry.aligned(t.nations(), "SY")
    return out.stored.select(F.col("i0").alias("n"), F.col("i1").alias("m"), F.round("v", 4).alias("v"))


@query(f"WITH {NATIONS}, p AS (SELECT least(n, m) AS n, greatest(n, m) AS m, sum(v) AS v FROM w WHERE n <> m GROUP BY ALL) SELECT n, m, round(v, 4) AS v FROM p UNION ALL SELECT m, n, round(v, 4) FROM p")
def recast_symmetry(t: Tables):
    """Symmetric with a diagonal, then without."""
    return rows(symmetry.recast(symmetry.symmetrize(t.nations(), "SY"), "SH"), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(CASE WHEN n = m THEN 0.5 * v ELSE v END, 4) AS v FROM w")
def diagonal_scaled(t: Tables):
    return rows(symmetry.scale_diagonal(t.nations(), 0.5), "nm")


# Algebras


@query(f"WITH {NATIONS} SELECT n, max(v) AS v FROM w GROUP BY ALL")
def monoid_sum(t: Tables):
    """A monoid has only a sum; here the largest."""
    w = t.nations()
    return rows(einsum("nm->n", w, algebra=monoid("largest", F.max, float("-inf"))), "n", None)


@query("SELECT l_returnflag AS flag, round(sum(l_quantity), 4) AS a, round(sum(l_tax), 4) AS b FROM lineitem GROUP BY ALL")
def monoid_of_pairs(t: Tables):
    flags = {"A": 0, "N": 1, "R": 2}
    at = F.coalesce(*(F.when(F.col("l_returnflag") == c, F.lit(k)) for c, k in flags.items())).cast("long")
    pairs = t.read("lineitem").select(F.monotonically_increasing_id().alias("i0"), at.alias("i1"), F.struct(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b")).alias("v"))
    x = einsum("ki->i", Tensor(pairs, (1 << 40, 3), algebra=PAIRS), algebra=PAIRS)
    name = F.element_at(F.array(*(F.lit(c) for c in flags)), (F.col("i0") + 1).cast("int"))
    return x.df.select(name.alias("flag"), F.round("v.a", 4).alias("a"), F.round("v.b", 4).alias("b"))


@query(f"WITH {NATIONS} SELECT n, m, round(-v, 4) AS v FROM w")
def group_inverse(t: Tables):
    w = t.nations()
    return rows(w.map(ring("float64").minus), "nm")


@query("SELECT p_partkey AS p, p_brand AS v FROM part")
def set_elements(t: Tables):
    """A set's elements, strings here, have neither sum nor product; handles hold, slice and permute them."""
    n = t.length("part", "p_partkey")
    x = Tensor(t.read("part").select(F.col("p_partkey").alias("i0"), F.col("p_brand").alias("v")), (n,), algebra=Algebra("set"))
    return x[::-1][::-1].df.select(F.col("i0").alias("p"), "v")


# Scheduling and profiling


@query(f"WITH {NATIONS} SELECT round(sum(v), 2) AS a, round(sum(v), 2) AS b, true AS counted, true AS timed FROM w")
def scheduled(t: Tables):
    """Two statements that don't need each other, then one that needs both; counted and timed."""
    w, kept = t.nations(), {}
    flops = FlopCounter()
    flops.add(w.i("nk") * w.i("km"))
    s = Schedule()
    s.set_max_partitions(min(2, World(t.spark).size))
    s.record(lambda: kept.update(a=float(w.sum())), writes=("a",))
    s.record(lambda: kept.update(b=float(w.T.sum())), writes=("b",))
    s.record(lambda: kept.update(c=kept["a"] - kept["b"]), reads=("a", "b"), writes=("c",))
    Profile.switch(True)
    with TimerEpoch("epoch") as epoch:
        s.execute()
        Profile.run(w.named("trade"))
    Profile.switch(False)
    timed = epoch.seen["trade"][1] == 1 and "epoch" in epoch.seen and "trade" not in Timer.totals
    return one(t.spark, a=round(kept["a"], 2), b=round(kept["b"], 2), counted=flops.flops > 0 and abs(kept["c"]) < 1e-6, timed=timed)


@query(f"WITH {REGIONS} SELECT x, y, z, round(v * (z + 1), 6) AS v FROM q CROSS JOIN range(3) s(z)")
def stacked_regions(t: Tables):
    r = regions(t)
    return rows(stack([(r * (k + 1.0)).reshape(5, 5, 1) for k in range(3)], 2), "xyz", 6)
