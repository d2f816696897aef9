"""Tensors of matrices of different sizes against NumPy on the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import elements
from gridloom.operators.elements import MATRICES, gathered, scattered
from gridloom.operators.tensor import einsum


def made(spark, a: np.ndarray, rows: list[int], columns: list[int]):
    """An array as elements cut at the sums of rows and columns; those without an entry aren't stored."""
    of = lambda sizes: [(b, k) for b, n in enumerate(sizes) for k in range(n)]
    r, c = of(rows), of(columns)
    entries = [(*(x for x in (r[i][0], c[j][0], r[i][1], c[j][1])), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    sizes = lambda own, key, name: spark.createDataFrame(list(enumerate(own)), f"{key} long, {name} int")
    df = spark.createDataFrame(entries, "i0 long, i1 long, p long, q long, v double").repartition(3)
    return gathered(df, sizes(rows, "i0", "rows"), sizes(columns, "i1", "columns"), (len(rows), len(columns)))


def whole(df, rows: list[int], columns: list[int]) -> np.ndarray:
    out = np.zeros((sum(rows), sum(columns)))
    top, left = np.cumsum([0, *rows]), np.cumsum([0, *columns])
    for r in df.collect():
        out[top[r["i0"]] + r["p"], left[r["i1"]] + r["q"]] += r["v"]
    return out


@pytest.mark.parametrize("limit", [64 << 20, 8])
def test_products_of_elements_of_different_sizes(spark, monkeypatch, limit):
    monkeypatch.setattr(elements, "BYTES", limit)
    rng = np.random.default_rng(1)
    rows, inner, columns = [1, 4, 2], [3, 1, 2, 5], [2, 6]
    a, b = rng.standard_normal((7, 11)), rng.standard_normal((11, 8))
    a[1:5, 3:4] = 0.0  # an element that isn't there
    x, y = made(spark, a, rows, inner), made(spark, b, inner, columns)
    assert x.df.count() == 11 and np.allclose(whole(scattered(x), rows, inner), a)
    got = einsum("ij,jk->ik", x, y, algebra=MATRICES)
    assert np.allclose(whole(scattered(got), rows, columns), a @ b)
    z = made(spark, rng.standard_normal((8, 3)), columns, [1, 2])
    three = einsum("ij,jk,kl->il", x, y, z, algebra=MATRICES)
    assert np.allclose(whole(scattered(three), rows, [1, 2]), a @ b @ whole(scattered(z), columns, [1, 2]))


def test_sums_of_elements(spark):
    a = np.arange(12.0).reshape(4, 3)
    x = made(spark, a, [2, 2], [1, 2])
    # Elements of a column are of one size and add up; those of a row aren't.
    down = einsum("ij->j", x, algebra=MATRICES).df.orderBy("i0").collect()
    assert [r["v"]["values"] for r in down] == [[6.0, 12.0], [8.0, 10.0, 14.0, 16.0]]
    with pytest.raises(Exception, match="don't add up"):
        einsum("ij->i", x, algebra=MATRICES).df.collect()
    with pytest.raises(Exception, match="don't multiply"):
        einsum("ij,jk->ik", x, x, algebra=MATRICES).df.collect()
    one = made(spark, a[:, :1], [2, 2], [1])
    assert einsum("ij->", one, algebra=MATRICES).df.first()["v"]["values"] == [6.0, 12.0]
    assert einsum("ij,jk->ik", x._with(x.df.where("false")), x, algebra=MATRICES).df.count() == 0
    assert x.df.select(F.col("v.rows")).distinct().count() == 1


def test_elements_with_few_values_store_those(spark, monkeypatch):
    """A graph's elements: what is stored and multiplied is entries, not places; elements with many values stay whole, and both kinds meet."""
    monkeypatch.setattr(elements, "EXPANDED", 7)
    rng = np.random.default_rng(2)
    sizes = [40, 30, 50]
    a = np.where(rng.random((120, 120)) < 0.05, rng.integers(1, 9, (120, 120)), 0).astype(float)
    a[:40, 40:70] = rng.integers(1, 9, (40, 30))  # one element is full
    x = made(spark, a, sizes, sizes)
    stored = {(r["i0"], r["i1"]): r["n"] for r in x.df.select("i0", "i1", F.size("v.values").alias("n")).collect()}
    assert stored[0, 1] == 1200 and all(n < 0.1 * sizes[i] * sizes[j] for (i, j), n in stored.items() if (i, j) != (0, 1))
    assert np.array_equal(whole(scattered(x), sizes, sizes), a)
    got = einsum("ij,jk->ik", x, x, algebra=MATRICES)
    assert np.array_equal(whole(scattered(got), sizes, sizes), a @ a)
