"""What holds at sizes where the plain way doesn't: neighbours by cells, random places by a counter, graph searches that end by themselves, raw files written by tasks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import graphs, workloads
from gridloom.operators.tensor import Tensor
from gridloom.sources import files, raw


@pytest.mark.parametrize("dimensions,cell", [(1, 4096), (2, 5), (3, 3)])
def test_neighbours_are_those_of_brute_force(spark, monkeypatch, dimensions, cell):
    monkeypatch.setattr(workloads, "CELL", cell)
    rng = np.random.default_rng(dimensions)
    x = np.concatenate([rng.uniform(-20, 20, (90, dimensions)), rng.normal(0, 0.3, (60, dimensions)), np.zeros((4, dimensions))])
    names = [f"p{k}" for k in range(dimensions)]
    points = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(999, *[None] * dimensions), (998, *[float("nan")] * dimensions)], f"i0 long, {', '.join(f'{n} double' for n in names)}")
    pairs = workloads.neighbours(points, names, 1.5)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i, j in zip(*np.nonzero(away <= 1.5)) if i != j}
    got = [(r["i0"], r["i1"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    force = workloads.within(points, names, 1.5, lambda a, b: a - 2 * b, names[0], len(x)).to_numpy()
    assert np.allclose(force, [sum(x[i, 0] - 2 * x[j, 0] for j in range(len(x)) if (i, j) in want) for i in range(len(x))])


def test_sparse_random_places_cost_what_they_are(spark):
    """10^5 entries of 10^12 places: exactly so many, all different, the same for a seed however they are partitioned."""
    t = Tensor.random(spark, (10**6, 10**6), 2.0, 3.0, seed=5, fraction=1e-7)
    assert t.df.count() == t.df.select("i0", "i1").distinct().count() == 10**5
    low, high, first, last = t.df.agg(F.min("v"), F.max("v"), F.min("i0"), F.max("i1")).first()
    assert 2.0 <= low < high < 3.0 and first < 1000 and last > 10**6 - 1000
    total = lambda: Tensor.random(spark, (50, 60), seed=3, fraction=0.05).df.orderBy("i0", "i1").collect()
    one = total()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert total() == one and len(one) == 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Tensor.random(spark, (40, 5), fraction=1e-9).df.count() == 0
    z = Tensor.random(spark, (30, 30), fraction=0.1, dtype="complex128")
    assert z.df.count() == 90 and (Tensor.random(spark, (30, 30), 0, 9, fraction=0.1, dtype="int32").to_numpy() < 9).all()


def chain(spark, n: int) -> Tensor:
    """A line of n vertices, each edge of weight 1, and a second way of equal weight around every other vertex."""
    edges = [(k, k + 1, 1.0) for k in range(n - 1)] + [(k, k + 2, 2.0) for k in range(0, n - 2, 2)]
    return Tensor(spark.createDataFrame(edges, "i0 long, i1 long, v double"), (n, n))


def test_hops_to_the_end(spark):
    n = 40
    got = {(r["i0"], r["i1"]): (r["w"], r["h"]) for r in graphs.path_hops(chain(spark, n).df).collect()}
    assert len(got) == n * (n - 1) // 2
    # Two vertices at a time from even ones.
    assert got[(0, 39)] == (39.0, 20) and got[(1, 4)] == (3.0, 2)
    assert (0, 39) not in {(r["i0"], r["i1"]) for r in graphs.path_hops(chain(spark, n).df, 2).collect()}


def test_path_counts_end_by_themselves(spark, monkeypatch):
    n, writes = 13, []
    plain = graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: writes.append(1) or plain(df))
    got = {r["i"]: (r["w"], r["m"]) for r in graphs.path_counts(chain(spark, n).df, 0).collect()}
    assert got == {k: (float(k), 2 ** (k // 2)) for k in range(n)}
    # The edges once, and two writes for each of as many rounds as the longest path has edges and one more.
    assert len(writes) == 1 + 2 * n


def test_betweenness_by_batches(spark):
    """A square with a tail: two ways from corner to corner."""
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    rows = [(*e, 1.0) for a, b in edges for e in ((a, b), (b, a))]
    t = Tensor(spark.createDataFrame(rows, "i0 long, i1 long, v double"), (5, 5))
    assert np.allclose(graphs.betweenness(t, batch=3).to_numpy(), [1, 2, 2, 7, 0])


@pytest.mark.parametrize("edges", [1 << 21, 40])
def test_searches_hold_batches_and_slabs(spark, monkeypatch, edges):
    """Sources in batches of 3, and edges in slabs where a task holds only some, against brute force; pairs are joined with nothing."""
    monkeypatch.setattr(graphs, "BATCH", 3)
    monkeypatch.setattr(graphs, "EDGES", edges)
    n, rng = 23, np.random.default_rng(5)
    w = np.where(rng.random((n, n)) < 0.18, rng.integers(1, 9, (n, n)), 0).astype(float)
    w[7] = w[:, 7] = w[9] = 0.0
    np.fill_diagonal(w, 0.0)
    a = Tensor.from_numpy(spark, w, sparse=True)
    one = np.where(w > 0, w * 1000 + 1, np.inf)
    level, by_hops = one, {}
    for k in range(n):
        by_hops[k + 1] = level
        level = np.minimum(level, (level[:, :, None] + one[None]).min(axis=1))
    far = by_hops[n].copy()
    np.fill_diagonal(far, 0.0)
    got = graphs.all_shortest_paths(a)
    assert got.df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1, "only vertices without edges are looked up"
    assert np.array_equal(got.to_numpy(), np.where(far < np.inf, far // 1000, np.inf))
    for rounds, most in ((None, n), (1, 2), (2, 4)):
        rows = {(r["i0"], r["i1"]): r["w"] * 1000 + r["h"] for r in graphs.path_hops(a.df, rounds).collect()}
        assert rows == {(i, j): by_hops[most][i, j] for i, j in zip(*np.nonzero(by_hops[most] < np.inf))}
    with pytest.raises(Exception, match="negative weight"):
        graphs.all_shortest_paths(Tensor.from_numpy(spark, np.array([[0, 1.0], [-2.0, 0]]), sparse=True)).df.collect()


def test_betweenness_in_tasks_is_that_of_relations(spark, monkeypatch):
    rng = np.random.default_rng(6)
    w = np.where(rng.random((15, 15)) < 0.25, rng.integers(1, 4, (15, 15)), 0).astype(float)
    a, writes, plain = Tensor.from_numpy(spark, w, sparse=True), [], graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: writes.append(1) or plain(df))
    whole, some = graphs.betweenness(a, batch=4).to_numpy(), graphs.betweenness(a, [3, 8], 4).to_numpy()
    # The edges and the vertices, however many rounds there are.
    assert len(writes) == 4
    monkeypatch.setattr(graphs, "EDGES", 1)
    assert np.allclose(whole, graphs.betweenness(a).to_numpy()) and np.allclose(some, graphs.betweenness(a, [3, 8]).to_numpy())


def test_transform_longer_than_letters(spark):
    """2^21 places, more modes of two than there were letters for: an impulse, and what it turns into at some places."""
    n = 1 << 21
    x = Tensor(spark.createDataFrame([(3, 2.0)], "i0 long, v double"), (n,))
    for got in (workloads.fft(x), workloads.fft_split(x, 1 << 11)):
        assert got.df.count() == n
        found = {r["i0"]: complex(*r["v"]) for r in got.df.where("i0 % 262145 = 7").collect()}
        assert len(found) == 8 and all(abs(v - 2 * np.exp(-2j * np.pi * 3 * k / n)) < 1e-9 for k, v in found.items())


@pytest.mark.parametrize("meeting", [1, 2, 4])
def test_sort_writes_nothing_on_the_way(spark, monkeypatch, meeting):
    monkeypatch.setattr(workloads, "MEETING", meeting)
    monkeypatch.setattr(workloads, "checkpointed", None)
    x = np.random.default_rng(3).integers(-50, 50, 512).astype(float)
    x[100:140] = 0.0
    got = workloads.bitonic_sort(Tensor.from_numpy(spark, x, sparse=True), block=8)
    assert "Broadcast" not in got.df._jdf.queryExecution().executedPlan().toString()
    assert np.array_equal(got.to_numpy(), np.sort(x))


def test_groups_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(workloads, "PART", 3)
    rng = np.random.default_rng(4)
    x, g = rng.standard_normal(40), np.where(np.arange(40) < 25, 0, rng.integers(1, 5, 40))
    values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i0 long, v double")
    groups = spark.createDataFrame([(k, int(v)) for k, v in enumerate(g)], "i0 long, g long")
    want = {i: sum(x[i] - 2 * x[j] for j in range(40) if j != i and g[i] == g[j]) for i in range(40) if (g == g[i]).sum() > 1}
    sums = {r["i0"]: r["v"] for r in workloads.grouped(values, groups, lambda a, b: a - 2 * b).collect()}
    assert sums.keys() == want.keys() and np.allclose([sums[i] for i in want], list(want.values()))
    both = workloads.grouped(values, groups, lambda a, b: F.struct((a - 2 * b).alias("x"), F.lit(1).alias("y")), ["x", "y"])
    assert {r["i0"]: (round(r["x"], 9), r["y"]) for r in both.collect()} == {i: (round(v, 9), (g == g[i]).sum() - 1) for i, v in want.items()}
    joined = both._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in joined and "other" in joined


def test_neighbours_at_the_radius_are_those_of_bounds(spark):
    """Pairs exactly a radius apart: as doubles some are within the distance but not within bounds, and the other way round."""
    cents = np.arange(0, 3000, 7)
    x = np.concatenate([cents / 100, (cents + 15000) / 100])
    points = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i0 long, x double")
    got = {(r["i0"], r["i1"]) for r in workloads.neighbours(points, ["x"], 150.0).where("abs(d - 150) < 1e-6").collect()}
    away = x[:, None] - x[None]
    near = (np.sqrt(away * away) <= 150.0) & (np.abs(np.abs(away) - 150) < 1e-6)
    inside = near & (x[None] >= x[:, None] - 150.0) & (x[None] <= x[:, None] + 150.0)
    assert near.sum() > inside.sum() > 0
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(inside))))


def test_raw_files_come_from_tasks(spark, tmp_path):
    a = np.random.default_rng(0).standard_normal((9, 7))
    path = f"file://{tmp_path}/dense"
    for _ in range(2):
        files.write_binary(Tensor.from_numpy(spark, a), path, block=10)
        assert sorted(os.listdir(tmp_path / "dense")) == [raw.name_of(k) for k in range(7)]
        assert np.array_equal(files.read_binary(spark, path, a.shape).to_numpy(), a)
    assert b"".join((tmp_path / "dense" / raw.name_of(k)).read_bytes() for k in range(7)) == a.tobytes()


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/failed"
    blocks = spark.range(6).repartition(3).selectExpr("id as block", "cast(if(id = 4, raise_error('lost'), 'x') as binary) as content")
    with pytest.raises(Exception):
        raw.write_blocks(blocks, path)
    # Attempts that were still running may leave something in the hidden folder, but no file has its name.
    assert [f for f in os.listdir(path) if not f.startswith("_")] == [] and spark.read.format("binaryFile").load(path).count() == 0


def test_a_failed_attempt_leaves_no_file(tmp_path):
    writer = raw.RawWriter(str(tmp_path))

    def rows():
        yield {"block": 0, "content": b"first"}
        raise OSError("disk")

    with pytest.raises(OSError):
        writer.write(rows())
    assert os.listdir(tmp_path / raw.ATTEMPTS) == []
    good = writer.write(iter([{"block": 0, "content": b"again"}]))
    writer.commit([good, None])
    assert os.listdir(tmp_path) == [raw.name_of(0)] and (tmp_path / raw.name_of(0)).read_bytes() == b"again"
