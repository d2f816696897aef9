"""Statistics of operands: what they say of joins, and the orders they choose."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.tensor import Tensor, einsum
from gridloom.plans import planner
from gridloom.plans.statistics import Shares, Statistics, measured


def skewed(spark, rows: int, n: int, seed: int, hot: float) -> Tensor:
    """Entries of an n x n tensor whose second index is 7 in a share of rows and spread evenly in the others."""
    x = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(n)).cast("bigint")
    unit = F.pmod(F.xxhash64(F.lit(seed + 9), "id"), F.lit(1000)) / 1000
    df = spark.range(rows).select(x(0).alias("i0"), F.when(unit < hot, F.lit(7).cast("bigint")).otherwise(x(1)).alias("i1"), F.lit(1.0).alias("v"))
    return Tensor(df.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (n, n), rows=rows)


def joined(a: Tensor, ka: str, b: Tensor, kb: str) -> int:
    return a.df.select(F.col(ka).alias("k")).join(b.df.select(F.col(kb).alias("k")), "k").count()


def test_one_pass_measures_all(spark):
    a = skewed(spark, 20_000, 3000, 1, 0.3)
    found = measured(a.df, a.keys)
    rows = a.df.count()
    assert found.rows == rows
    assert found.modes[0].distinct == pytest.approx(a.df.select("i0").distinct().count(), rel=0.1)
    # Chance alone makes no index frequent.
    assert max(found.modes[0].frequent.values(), default=0) < 0.002
    share = a.df.where("i1 = 7").count() / rows
    assert found.modes[1].frequent[7] == pytest.approx(share, rel=0.1)
    assert measured(a.df.where("false"), a.keys).rows == 0


@pytest.mark.parametrize("hot_a,hot_b", [(0.0, 0.0), (0.3, 0.0), (0.3, 0.2), (0.05, 0.6)])
def test_join_sizes_within_twice(spark, hot_a, hot_b):
    a, b = skewed(spark, 8000, 2000, 1, hot_a).analyzed(), skewed(spark, 6000, 2000, 5, hot_b).analyzed()
    sizes = dict.fromkeys("ijk", 2000)
    x, y = a.leaf("ij"), b.leaf("kj")
    got, _, _ = planner.estimate((frozenset("ij"), x.rows), (frozenset("kj"), y.rows), {"i", "k"}, sizes, x.shares, y.shares)
    real = joined(a, "i1", b, "i1")
    assert real / 2 <= got <= real * 2
    # Sizes of grids alone take every index to be equally frequent.
    blind, _, _ = planner.estimate((frozenset("ij"), x.rows), (frozenset("kj"), y.rows), {"i", "k"}, sizes)
    assert abs(np.log(got / real)) <= abs(np.log(blind / real)) + 0.1


def test_shares_of_what_is_left():
    a, b = Shares(10.0, {1: 0.5}), Shares(10.0, {1: 0.4, 2: 0.3})
    agree, both = a.met(b)
    # Index 1: 0.5 * 0.4; index 2: (0.5 / 9) * 0.3; eight others.
    rest = (0.5 - 0.5 / 9) * 0.3 / 8
    assert agree == pytest.approx(0.2 + 0.5 / 9 * 0.3 + rest)
    assert both.frequent[1] == pytest.approx(0.2 / agree)
    assert Shares(10.0).met(Shares(4.0))[0] == pytest.approx(0.1)
    # Added up to at most 20 rows an index, a frequent one is no longer so frequent.
    assert a.bounded(1000, 20).frequent[1] == pytest.approx(20 / 200)


def test_a_skewed_product_is_joined_in_another_order(spark):
    """Four operands in a ring: grid sizes see four equal joins; statistics see that two of them meet in a hot index."""
    n = 2000
    a, b = skewed(spark, 5000, n, 1, 0.5), skewed(spark, 5000, n, 2, 0.5)
    c, d = skewed(spark, 5500, n, 3, 0.0), skewed(spark, 3000, n, 4, 0.0)
    # a and b share their hot label j, c and d others.
    notation, labels = "ij,kj,kl,li->", ["ij", "kj", "kl", "li"]
    sizes = dict.fromkeys("ijkl", n)

    def steps(operands):
        leaves = [t.leaf(x) for t, x in zip(operands, labels)]
        return planner.order([(frozenset(x.labels), x.rows) for x in leaves], set(), sizes, [x.shares for x in leaves])

    plain = [Tensor(t.df, t.shape, rows=t.df.count()) for t in (a, b, c, d)]
    known = [t.analyzed() for t in (a, b, c, d)]
    assert steps(plain) != steps(known)

    def rows_joined(order):
        live, total = {k: (t.df.toDF(*x, "v").drop("v"), set(x)) for k, (t, x) in enumerate(zip(plain, labels))}, 0
        fresh = len(live)
        for i, j in order:
            (x, lx), (y, ly) = live.pop(i), live.pop(j)
            both = x.join(y, sorted(lx & ly))
            total += both.count()
            left = set().union(*(s for _, s in live.values())) & (lx | ly)
            live[fresh] = (both.select(*sorted(left)).distinct() if left else both.limit(0).select(), left)
            fresh += 1
        return total

    assert rows_joined(steps(known)) < rows_joined(steps(plain)) / 3
    assert einsum(notation, *known).item() == pytest.approx(einsum(notation, *plain).item())


def test_statistics_stay_with_the_handle(spark):
    t = skewed(spark, 500, 50, 1, 0.2).analyzed()
    assert isinstance(t.statistics, Statistics) and t.sparsify().statistics is None
    assert np.allclose(einsum("ij,jk->ik", t, t.astype("float32").analyzed()).to_numpy(), t.to_numpy() @ t.to_numpy())
