"""Hard-negative mining: k-means inverted lists with stored centroid radii, searched by Cauchy-Schwarz bounds.

Every vector is in the list of its nearest centroid; a list keeps its radius, the greatest distance of a member from the centroid. A
member x of a list with centroid m and radius r has a.x between a.m - |a| r and a.m + |a| r. A search wants the k best scores
within a window. Lists whose bounds lie outside the window are skipped, and so is a list whose upper bound is strictly below the kth score that is
known already. That score comes first from the lists of greatest upper bound (SEEDS for each anchor), then from what a task has seen. What bounds can't exclude is
scored exactly, so results are those of a search of everything; centroids come from a bounded sample (FIT vectors of least hash), which bounds
work only.

The index is a table sorted by list and id, ranged evenly, so that a list of any size is spread over tasks. Anchors are taken in slabs of bounded size
(ANCHORS), known to every task; a slab's search is one pass over the index, with matrix products of the anchors that need a list with the
list's members, and gives a task's k best for each anchor. Only those are shuffled. First come the positives of the anchor's label,
then for each positive the negatives of other labels in its window.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; vectors of different length are compared as
if the shorter one ended in zeros; a null id is no anchor and comes after all ids in ties; every row is a row of its own, repeated ids and vectors too; an empty table
or one without anchors gives an empty result. Scores are exact as long as they fit 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors that centroids are fitted to, rounds of fitting, members of a list on average and the most lists.
FIT, ROUNDS, MEMBERS, LISTS = 16_384, 8, 256, 1024
#: Anchors of a slab, and lists by which an anchor's first kth score is found.
ANCHORS, SEEDS = 8192, 4
#: Scores held at once in a task.
SCORES = 1 << 20
POSITIVES, NEGATIVES = 5, 10
LAST = (1 << 63) - 1


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows, ended by zeros to the longest (or to width)."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means from members at equal steps; one without members stays where it is."""
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centroids)[0]
        many = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], np.cumsum(many)[:-1]]), len(x) - 1), axis=0)
        centroids = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the distance from it, worked out from the difference itself."""
    near = np.argmin((centroids**2).sum(axis=1)[None, :] - 2 * (x @ centroids.T), axis=1)
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))


class Index:
    """rows: (list, id, label, vector, row) sorted by list and id; centroids; radii."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, radii: np.ndarray):
        self.rows, self.centroids, self.radii = rows, centroids, radii


def build(vectors: DataFrame, lists: int | None = None) -> Index:
    """vectors: (id, label, vector array<double>), all finite. The index is written to the shared folder."""
    spark = vectors.sparkSession
    sized = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = sized["width"] or 0
    # About twice as many by a share of the hashes, so that no task gets more, then those of least hash.
    place = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 40))
    share = min(1.0, 2 * FIT / max(1, sized["n"]))
    sample = vectors.where(place < int(share * (1 << 40)) + 1).orderBy(place, "id").limit(FIT).select("vector").toArrow()
    x = np.concatenate([_matrix(c, width) for c in sample.column(0).chunks]) if len(sample) else np.zeros((0, width))
    scale = np.abs(x).max(initial=0.0) or 1.0
    centroids = _fitted(x / scale, lists or max(1, min(LISTS, sized["n"] // MEMBERS))) * scale if len(x) else x
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, away = _nearest(_matrix(b.column(2), width), shared.value) if len(b) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(away), *b.columns], ["list", "away", "id", "label", "vector"])

    kind = vectors.schema["label"].dataType.simpleString()
    placed = vectors.select(F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("id"), "label", "vector").mapInArrow(run, f"list int, away double, id long, label {kind}, vector array<double>")
    ranged = placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").withColumn("row", F.monotonically_increasing_id())
    rows = common.materialise(ranged, "inverted-lists")
    radii = np.zeros(len(centroids))
    for r in rows.groupBy("list").agg(F.max("away").alias("radius")).collect():
        radii[r["list"]] = r["radius"]
    return Index(rows.drop("away"), centroids, radii)


class Slab:
    """Anchors with their windows: arrays over (anchor, window), the kth score known so far, and bounds by list."""

    def __init__(self, row: np.ndarray, label: np.ndarray, vector: np.ndarray, index: Index):
        self.row, self.label, self.vector = row, label, vector
        self.size = np.sqrt((vector**2).sum(axis=1))
        self.centroids, self.radii = index.centroids, index.radii
        self.low = self.high = self.least = np.zeros((len(row), 0))

    def windows(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> None:
        self.low, self.high, self.least = low, high, least

    def bounds(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of scores by (anchor, list), with room for rounding."""
        middle = self.vector @ self.centroids[lists].T
        reach = self.size[:, None] * self.radii[lists][None, :]
        reach += 1e-9 * (reach + self.size[:, None] * np.sqrt((self.centroids[lists] ** 2).sum(axis=1))[None, :]) + 1e-6
        return middle - reach, middle + reach

    def wanted(self, lists: np.ndarray) -> np.ndarray:
        """(anchor, list): may a member's score lie in one of the anchor's windows and reach its kth score?"""
        low, high = self.bounds(lists)
        out = np.zeros(low.shape, bool)
        for w in range(self.low.shape[1]):
            open_ = self.low[:, w] <= self.high[:, w]
            out |= open_[:, None] & (high >= np.maximum(self.low[:, w], self.least[:, w])[:, None]) & (low <= self.high[:, w][:, None])
        return out

    def first(self) -> np.ndarray:
        """(anchor, list): the lists of greatest upper bound among those wanted."""
        every = np.arange(len(self.radii))
        upper = np.where(self.wanted(every), self.bounds(every)[1], -np.inf)
        seeds = min(SEEDS, len(every))
        at = np.argpartition(-upper, seeds - 1, axis=1)[:, :seeds]
        out = np.zeros(upper.shape, bool)
        np.put_along_axis(out, at, True, axis=1)
        return out & np.isfinite(upper)


class Best:
    """The k first by (score descending, id) of each (anchor, window), and the kth score of each."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.windows = k, least.copy(), least.shape[1]
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        self.fresh: list[list[np.ndarray]] = []
        self.many = 0

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        self.fresh.append([query, score, id_])
        self.many += len(query)
        if self.many > SCORES:
            self.merge()

    def merge(self) -> None:
        query, score, id_ = (np.concatenate(x) for x in zip(self.held, *self.fresh))
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
        kept = rank < self.k
        self.held, self.fresh, self.many = [query[kept], score[kept], id_[kept]], [], 0
        full = rank == self.k - 1
        flat = self.least.reshape(-1)
        flat[query[full]] = np.maximum(flat[query[full]], score[full])


def _searched(index: Index, slab: Slab, k: int, same: bool, visits: np.ndarray | None) -> DataFrame:
    """(anchor, window, score, id): each task's k best of each anchor and window. same: members of the anchor's label other than itself, else of other labels. visits: (anchor, list) to look at, None for all wanted."""
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast((slab, visits))
    width = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, visits = shared.value
        best = Best(slab.least, k)
        windows = slab.low.shape[1]
        for b in batches:
            if not len(b):
                continue
            lists, ids, labels, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            x = _matrix(b.column(3), width)
            cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1), len(lists)]
            need = slab.wanted(lists[cuts[:-1]]) if visits is None else visits[:, lists[cuts[:-1]]]
            for c, (start, end) in enumerate(zip(cuts, cuts[1:])):
                at = np.flatnonzero(need[:, c])
                step = max(1, SCORES // (end - start))
                for part in (at[j : j + step] for j in range(0, len(at), step)):
                    scores = slab.vector[part] @ x[start:end].T
                    fits = slab.label[part][:, None] == labels[None, start:end]
                    fits = fits & (slab.row[part][:, None] != rows[None, start:end]) if same else ~fits
                    for w in range(windows):
                        low = np.maximum(slab.low[part, w], best.least[part, w])
                        i, j = np.nonzero(fits & (scores >= low[:, None]) & (scores <= slab.high[part, w][:, None]))
                        if len(i):
                            best.add(part[i] * windows + w, scores[i, j], ids[start + j])
        best.merge()
        query, score, id_ = best.held
        for at in range(0, len(query), 1 << 16):
            q = query[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((q // windows).astype(np.int32)), pa.array((q % windows).astype(np.int32)), pa.array(score[at : at + (1 << 16)]), pa.array(id_[at : at + (1 << 16)])], ["anchor", "window", "score", "id"])

    return index.rows.mapInArrow(run, "anchor int, window int, score double, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k first of what tasks gave, with ranks from 1."""
    rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _kth(found: DataFrame, slab: Slab, k: int) -> np.ndarray:
    """The kth score of each anchor and window of a slab, minus infinity where there are fewer."""
    out = np.full(slab.low.shape, -np.inf)
    rows = _first(found, k).groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()
    out[rows.column("anchor").to_numpy(), rows.column("window").to_numpy()] = rows.column("score").to_numpy()
    return out


def best(index: Index, slab: Slab, k: int, same: bool) -> DataFrame:
    """(anchor, window, score, id, rank): the k best of each anchor of a slab within each of its windows."""
    none = np.full(slab.low.shape, -np.inf)
    if len(slab.radii) > SEEDS:
        slab.windows(slab.low, slab.high, none)
        slab.windows(slab.low, slab.high, _kth(_searched(index, slab, k, same, slab.first()), slab, k))
    else:
        slab.windows(slab.low, slab.high, none)
    return _first(_searched(index, slab, k, same, None), k)


def mine(vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 30, most: int = 90, lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first positives the best negatives with least to most per cent of the positive's score.

    vectors: (id, label, vector array<double>) with finite components. anchors: an SQL condition on id.
    """
    spark = vectors.sparkSession
    index = build(vectors, lists)
    queries = index.rows.where(anchors).where(F.col("id") != LAST)
    number = F.row_number().over(W.partitionBy("part").orderBy("row")) - 1
    # Slabs of bounded size from sizes by partition, so that no window has all anchors.
    parted = queries.withColumn("part", F.shiftright("row", 33).cast("int"))
    before, at = {}, 0
    for r in parted.groupBy("part").count().orderBy("part").collect():
        before[r["part"]] = at
        at += r["count"]
    out = None
    if at:
        starts = spark.createDataFrame(list(before.items()), "part int, before long")
        numbered = common.materialise(parted.withColumn("number", number).join(starts, "part").withColumn("slab", F.floor((F.col("number") + F.col("before")) / ANCHORS).cast("int")).select("slab", "id", "label", "vector", "row"), "anchors")
        for s in range(-(-at // ANCHORS)):
            found = _mined(index, numbered.where(F.col("slab") == s), positives, negatives, least, most)
            out = found if out is None else out.unionByName(found)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return out if out is not None else spark.createDataFrame([], schema)


def _mined(index: Index, anchors: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    spark = anchors.sparkSession
    own = anchors.select("id", "label", "vector", "row").toArrow().combine_chunks()
    vector = _matrix(own.column("vector").combine_chunks(), index.centroids.shape[1])
    slab = Slab(own.column("row").to_numpy(), own.column("label").to_numpy(), vector, index)
    n = len(vector)
    slab.windows(np.full((n, 1), -np.inf), np.full((n, 1), np.inf), np.full((n, 1), -np.inf))
    found = best(index, slab, positives, True).toArrow()
    at, rank = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
    score, id_ = np.full((n, positives), np.nan), np.zeros((n, positives), np.int64)
    score[at, rank], id_[at, rank] = found.column("score").to_numpy(), found.column("id").to_numpy()
    # Whole scores from least to most per cent of the positive's; no window without a positive or below zero.
    low, high = np.ceil(score * least / 100), np.floor(score * most / 100)
    low, high = np.where(score >= 0, low, np.inf), np.where(score >= 0, high, -np.inf)
    slab.windows(low, high, np.full(low.shape, -np.inf))
    hard = best(index, slab, negatives, False)
    i, j = np.nonzero(~np.isnan(score))
    given = pa.table([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own.column("id").to_numpy()[i]), pa.array(id_[i, j]), pa.array(score[i, j].astype(np.int64))], ["anchor", "window", "anchor_id", "positive_id", "positive_score"])
    joined = hard.join(spark.createDataFrame(given), ["anchor", "window"])
    or_null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return joined.select("anchor_id", or_null("positive_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != LAST, F.col("id")).alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # floor() gives 64-bit integers; doubles beyond 52 bits are whole.
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    whole = F.transform("embedding", lambda x: floor(x.cast("double") * 256))
    return mine(rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("vector")), "id % 100 = 0")
