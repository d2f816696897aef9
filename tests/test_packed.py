"""Tensors with several groups of symmetric modes against NumPy on all of their entries."""

from itertools import permutations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import packed, symmetry
from gridloom.operators.packed import Packed, groups_of
from gridloom.operators.tensor import Tensor


def parity(p) -> int:
    return (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))


def summed(a: np.ndarray, groups) -> np.ndarray:
    """The sum over all orders of each group, with signs for AS; SH without equal indices."""
    for kind, modes in groups:
        out = np.zeros_like(a)
        for p in permutations(range(len(modes))):
            axes = list(range(a.ndim))
            for m, k in zip(modes, p):
                axes[m] = modes[k]
            out = out + (parity(p) if kind == "AS" else 1) * a.transpose(axes)
        if kind == "SH":
            grid = np.indices(a.shape)
            for i in range(len(modes)):
                for j in range(i):
                    out = np.where(grid[modes[i]] == grid[modes[j]], 0, out)
        a = out
    return a


def made(spark, shape, chain, seed, complex_=False):
    rng = np.random.default_rng(seed)
    a = rng.integers(-4, 5, shape) + (1j * rng.integers(-4, 5, shape) if complex_ else 0.0)
    a = summed(a, [(g.kind, g.modes) for g in groups_of(chain)])
    return a, Packed.pack(Tensor.from_numpy(spark, a, sparse=True), chain)


def test_chains():
    assert [(g.kind, g.modes) for g in groups_of(["SY", "SY", "NS", "AS", "NS", "NS"])] == [("SY", (0, 1, 2)), ("AS", (3, 4))]
    for bad in (["SY"], ["XX", "NS"], ["SY", "AS", "NS"]):
        with pytest.raises(ValueError):
            groups_of(bad)


@pytest.mark.parametrize("chain,n", [(["SY", "SY", "NS"], 4), (["AS", "AS", "NS"], 5), (["SH", "SH", "NS"], 4), (["AS", "NS", "SY", "NS"], 3)])
def test_stored_and_unpacked(spark, chain, n):
    a, x = made(spark, (n,) * len(chain), chain, 1)
    assert np.array_equal(x.unpacked().to_numpy(), a)
    assert x.df.count() <= x.stored_size() < a.size
    assert x.norm2() == pytest.approx(np.linalg.norm(a))
    assert np.array_equal((x + x * 2.0).unpacked().to_numpy(), 3 * a)
    raw = np.random.default_rng(2).integers(-4, 5, a.shape).astype(float)
    want = summed(raw, [(g.kind, g.modes) for g in groups_of(chain)])
    # Each stored place adds up the entries of its indices: those with equal ones have fewer of them than orders.
    got = Packed.aligned(Tensor.from_numpy(spark, raw), chain).unpacked().to_numpy()
    grid = np.indices(a.shape)
    apart = np.all([grid[i] != grid[j] for i in range(a.ndim) for j in range(i)], axis=0)
    assert np.array_equal(got[apart], want[apart])


def test_sizes():
    size = lambda chain, n: Packed(None, (n,) * len(chain), groups_of(chain)).stored_size()
    assert size(["SY", "SY", "NS"], 6) == comb(8, 3) and size(["AS", "AS", "AS", "NS"], 7) == comb(7, 4) and size(["SH", "NS", "NS"], 5) == comb(5, 2) * 5


CASES = [
    # Whole groups, summed and kept.
    ("abij,ijcd->abcd", "AS NS AS NS", "AS NS AS NS"),
    ("abij,ijcd->abcd", "SY NS SH NS", "SY NS SY NS"),
    ("abij,jicd->abcd", "NS NS AS NS", "AS NS NS NS"),
    ("abij,ijcd->bacd", "AS NS SY NS", "SY NS AS NS"),
    ("abc,cba->", "AS AS NS", "AS AS NS"),
    ("abc,abc->", "SY SY NS", "SY SY NS"),
    # Groups that are broken up.
    ("ij,jk->ik", "SY NS", "NS NS"),
    ("ij,jk->ik", "AS NS", "SY NS"),
    ("abc,bc->a", "SY SY NS", "NS NS"),
    ("abc,cb->a", "AS AS NS", "NS NS"),
    ("abc,cbd->ad", "AS AS NS", "AS AS NS"),
    ("abc,bcd->da", "SY SY NS", "SH SH NS"),
    ("abc,abd->cd", "AS AS NS", "SY NS NS"),
    ("abcd,cd->ab", "AS AS AS NS", "AS NS"),
    ("abcd,cd->ba", "SY SY SY NS", "NS NS"),
    # Labels of one operand only, of both and the result, and none in common.
    ("abc,d->d", "SY SY NS", "NS"),
    ("abc,d->d", "AS AS NS", "NS"),
    ("abc,ad->abcd", "SY SY NS", "NS NS"),
    ("ab,cd->abcd", "AS NS", "SY NS"),
    ("ab,b->ab", "SY NS", "NS"),
]


@pytest.mark.parametrize("notation,one,two", CASES)
def test_contractions(spark, notation, one, two):
    (la, lb), n = notation.split("->")[0].split(","), 4
    a, x = made(spark, (n,) * len(la), one.split(), 3)
    b, y = made(spark, (n,) * len(lb), two.split(), 4)
    got = packed.contract(notation, x, y)
    assert np.allclose(got.unpacked().to_numpy(), np.einsum(notation, a, b))
    for g in got.groups:
        at = [F.col(f"i{m}") for m in g.modes]
        assert got.df.where(~packed._ascending(at, g.kind)).count() == 0


def test_whole_groups_are_not_expanded(spark):
    """Two groups each, order 4: no row is repeated, and the join's rows are those of stored pairs."""
    n = 6
    _, x = made(spark, (n,) * 4, "AS NS AS NS".split(), 5)
    got = packed.contract("abij,ijcd->abcd", x, x)
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert [(g.kind, g.modes) for g in got.groups] == [("AS", (0, 1)), ("AS", (2, 3))]
    assert got.df.count() <= comb(n, 2) ** 2
    broken = packed.contract("abij,jc->abic", x, Tensor.from_numpy(spark, np.ones((n, n))))
    # Only the group that is broken up is dealt.
    assert broken.df._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_complex_values_and_pairs_of_the_handle(spark):
    a, x = made(spark, (4, 4, 4), ["AS", "AS", "NS"], 7, True)
    b, y = made(spark, (4, 4), ["SY", "NS"], 8, True)
    assert np.allclose(packed.contract("abc,cd->abd", x, y).unpacked().to_numpy(), np.einsum("abc,cd->abd", a, b))
    t = symmetry.pack(Tensor.from_numpy(spark, b), "SY")
    assert Packed.of(t).groups[0].kind == "SY"
    assert np.allclose(packed.contract("ab,bc->ac", t, t).unpacked().to_numpy(), b @ b)
    with pytest.raises(ValueError):
        packed.contract("aa,ab->b", t, t)
    with pytest.raises(ValueError):
        Packed(x.df, (4, 5, 4), groups_of(["AS", "AS", "NS"]))
