"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word (lower-cased, split at everything but letters and digits) is the mean of hashed embedding rows: its own and those of its
beginnings and endings, so that words never seen share what their parts have. Filters of widths 1, 2 and 3 run over the whole text, each one's maximum goes through
a rectifier into a logistic output. Embeddings start from the rows' smoothed log-odds in the training rows, then all weights are trained by
Adagrad; a logistic fit on rows kept out of training (a fifth, by hash) makes the score a probability. Thresholds by language are
chosen on the same rows; they don't change the score, and op9 gives them and what they would say in columns of their own.

Every labelled row counts: for the log-odds, for training or, where kept out, for the scale and thresholds. Rows are dealt by hash into
shards of bounded size, whatever their partitions; each shard goes through all of its rows in a task of its own, from the same weights on, and a
weight becomes the mean of those of the shards that moved it. Labels, language, source and id are never inputs of a score. Texts are read whole.

Defined results: null and empty texts have no words and get the score of a text in which nothing was found; without labelled rows of both classes every score
is the share of toxic rows (0 without rows); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS, SIZE = 1 << 17, 12
WIDTHS, FILTERS = (1, 2, 3), 8
#: Places whose filter values are held at once.
CHUNK = 1 << 16
#: Words whose vectors a worker remembers between batches.
REMEMBERED = 300_000
#: Rows and characters of a shard, on average at most.
SHARD_ROWS, SHARD_CHARS = 16_384, 48_000_000
#: Words whose rows are found at once, and bytes of the longest of them.
AT_ONCE, LONG = 1 << 14, 60
#: Bits of a block of the filter of labelled ids.
BLOCK = 1 << 15
#: Units of a weight's and a logit's whole numbers, whose sums don't depend on their order.
WEIGHT_UNIT, LOGIT_UNIT = 2.0**-32, 2.0**-10
_WORD = re.compile(r"[^\W_]+")


def split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(word: str) -> list[int]:
    """Rows of the embedding table: of the word, of its beginnings of 3 to 10 and its endings of 3 to 5 characters. A row's remainder by 3 tells which."""
    marks = [(0, word), *((1, word[:n]) for n in range(3, min(11, len(word)))), *((2, word[-n:]) for n in range(3, min(6, len(word))))]
    return sorted({3 + 3 * (xxhash.xxh32_intdigest(f"{k}{g}") % (ROWS // 3 - 2)) + k for k, g in marks})


_P = tuple(np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _hashed(data: np.ndarray, marks: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh32 of many strings at once: each its mark, one byte, and then so many bytes of data, which has four bytes more than any of them reads."""
    four = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    marks, length = marks.astype(np.uint32), sizes + 1

    def word(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The at-th four bytes of some strings."""
        first = marks[own] | four[begin[own]] << np.uint32(8)
        return np.where(at == 0, first, four[begin[own] + np.maximum(4 * at - 1, 0)])

    h = np.full(len(sizes), _P[4])
    long = np.flatnonzero(length >= 16)
    if len(long):
        v = [np.full(len(long), (start + (1 << 32)) % (1 << 32), np.uint32) for start in (int(_P[0]) + int(_P[1]), int(_P[1]), 0, -int(_P[0]))]
        for k in range(int(length[long].max()) // 16):
            on = np.flatnonzero(length[long] // 16 > k)
            for i in range(4):
                v[i][on] = _turned(v[i][on] + word(long[on], np.full(len(on), 4 * k + i)) * _P[1], 13) * _P[0]
        h[long] = sum(_turned(x, by) for x, by in zip(v, (1, 7, 12, 18)))
    h += length.astype(np.uint32)
    for k in range(3):
        at = length // 16 * 4 + k
        on = np.flatnonzero(at < length // 4)
        h[on] = _turned(h[on] + word(on, at[on]) * _P[2], 17) * _P[3]
    for k in range(3):
        at = length // 4 * 4 + k
        on = np.flatnonzero(at < length)
        byte = np.where(at[on] == 0, marks[on], data[begin[on] + np.maximum(at[on] - 1, 0)].astype(np.uint32))
        h[on] = _turned(h[on] + byte * _P[4], 11) * _P[0]
    h = (h ^ h >> np.uint32(15)) * _P[1]
    h = (h ^ h >> np.uint32(13)) * _P[2]
    return h ^ h >> np.uint32(16)


def many_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What parts() gives for each word, one after the other, and how many rows each has; as columns, except for words of over LONG bytes."""
    column = pa.array(words, pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(column.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(4, np.uint8)])
    # Where characters begin, and the number of each word's first.
    at = np.append(np.flatnonzero(data[:-4] & 0xC0 != 0x80), ends[-1])
    first = np.searchsorted(at, ends)
    size = np.diff(first)
    short = np.flatnonzero((np.diff(ends) <= LONG) & (size > 0))
    whose, kinds, begin, end = [short], [np.zeros(len(short), np.int64)], [ends[short]], [ends[short + 1]]
    for kind, longest in ((1, 10), (2, 5)):
        for n in range(3, longest + 1):
            own = short[size[short] > n]
            whose.append(own)
            kinds.append(np.full(len(own), kind))
            begin.append(ends[own] if kind == 1 else at[first[own + 1] - n])
            end.append(at[first[own] + n] if kind == 1 else ends[own + 1])
    whose, kinds, begin, end = map(np.concatenate, (whose, kinds, begin, end))
    rows = 3 + 3 * (_hashed(data, 48 + kinds, begin, end - begin).astype(np.int64) % (ROWS // 3 - 2)) + kinds
    keys = [whose * ROWS + rows]
    for k in np.flatnonzero(np.diff(ends) > LONG).tolist():
        keys.append(k * ROWS + np.array(parts(words[k]), np.int64))
    # A word without characters is no word: row 0.
    keys = np.unique(np.concatenate([*keys, np.flatnonzero(size == 0) * ROWS]))
    return keys % ROWS, np.bincount(keys // ROWS, minlength=len(words)).astype(np.int64)


@dataclass
class TextCnn:
    table: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    shift: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def vectors(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean of each word's rows; counts: how many each has."""
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(self.table[rows], starts, axis=0) / counts[:, None].astype(np.float32) if len(counts) else np.zeros((0, SIZE), np.float32)

    def pooled(self, docs: list[np.ndarray], vectors: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Each document's largest filter values, where they are if asked for, and all words, documents apart by three of row 0 (no word). Filters start at a document's words and the first place after them, so none reads the next document."""
        gap = np.zeros(3, np.int64)
        ids = np.concatenate([p for d in docs for p in (d, gap)]) if docs else gap
        sizes = np.array([len(d) + 3 for d in docs], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        closed = np.sort(np.concatenate([ends - 2, ends - 1]))
        best = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64) if places else None
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            part = np.concatenate([ids[a : b + 2], np.zeros(max(0, b + 2 - len(ids)), np.int64)])
            x, n = vectors[part], b - a
            m = np.concatenate([sum(x[k : k + n] @ w[k] for k in range(len(w))) for w in self.filters], axis=1)
            m[closed[slice(*np.searchsorted(closed, [a, b]))] - a] = -np.inf
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            cut = np.maximum(starts[first:last], a) - a
            top = np.maximum.reduceat(m, cut, axis=0)
            if places:
                for k, (lo, hi) in enumerate(zip(cut, [*cut[1:], b - a])):
                    at = m[lo:hi].argmax(axis=0)
                    new = m[lo:hi][at, np.arange(m.shape[1])] > best[first + k]
                    where[first + k][new] = a + lo + at[new]
            np.maximum(best[first:last], top, out=best[first:last])
        return best, where, ids

    def logits(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        best, _, _ = self.pooled(docs, vectors)
        return np.maximum(best + self.bias, 0) @ self.out + self.shift

    def scores(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return self.scaled(self.logits(docs, vectors).astype(np.float64))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


class Numbers(dict):
    """Numbers of words in the order they come up in."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Texts to numbers of words, from 1 on (0 is no word); the words are kept."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = Numbers({"": 0})

    def __call__(self, text: str | None) -> np.ndarray:
        words = split(text)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def flat(self, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and counts of the words numbered from first on."""
        words = list(itertools.islice(self.known, first, None))
        found = [many_parts(words[k : k + AT_ONCE]) for k in range(0, max(1, len(words)), AT_ONCE)]
        return tuple(map(np.concatenate, zip(*found)))


def _log_odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each row of the table; shrunk where few have it. seen: how many documents of each class it is in; n: documents of each class."""
    total = seen.sum(0)
    rate = (seen + 0.5) / (np.maximum(1, n)[:, None] + 1)
    return (np.log(rate[1] / rate[0]) * total / (total + 8)).astype(np.float32)


def _gather(words: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of some words, one after the other, and their counts."""
    own = counts[words]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[words] - (ends - own), own)
    return rows[at], own


def started(log_odds: np.ndarray) -> TextCnn:
    """The weights that all shards start from."""
    rng = np.random.default_rng(7)
    model = TextCnn()
    model.table[:] = rng.normal(0, 0.1, (ROWS, SIZE))
    model.table[np.arange(ROWS), np.arange(ROWS) % 3] = log_odds
    model.table[0] = 0
    model.filters = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in model.filters:
        f[0, :3] += 0.5
    model.out[:] = np.abs(rng.normal(0, 0.1, len(model.out))) + 0.1
    return model


def _rounds(pool: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """size rows at a time, without end; all of the pool come up before any comes up again."""
    left = pool[:0]
    while True:
        while len(left) < size:
            left = np.concatenate([left, rng.permutation(pool)])
        yield left[:size]
        left = left[size:]


def fit(model: TextCnn, docs: list[np.ndarray], labels: np.ndarray, reader: Reader, seed: int = 0, epochs: int = 3, least_steps: int = 800, batch: int = 32, rate: float = 0.05) -> np.ndarray:
    """Train the model on these rows, each of which comes up at least once. Returns which rows of its table were moved."""
    y = labels.astype(np.float32)
    rng = np.random.default_rng([7, seed])
    rows, counts = reader.flat()
    starts = np.cumsum(counts) - counts
    weights = [model.table, *model.filters, model.bias, model.out]
    seen = [np.full(w.shape, 1e-2, np.float32) for w in weights]
    shift_seen = 1e-2
    # The classes' rows come up alike often, so rare labels are learned as well.
    pools = [p for p in (np.flatnonzero(y == k) for k in (0, 1)) if len(p)]
    turns = [_rounds(p, batch // 2, rng) for p in pools]
    for _ in range(max(least_steps, epochs * len(y) // batch, -(-max(map(len, pools)) // (batch // 2)))):
        picked = np.concatenate([next(t) for t in turns])
        words, inverse = np.unique(np.concatenate([docs[i] for i in picked] + [np.zeros(1, np.int64)]), return_inverse=True)
        own_rows, own_counts = _gather(words, rows, starts, counts)
        vectors = model.vectors(own_rows, own_counts)
        vectors[0] = 0
        sizes = np.cumsum([0] + [len(docs[i]) for i in picked])
        local = [inverse[a:b] for a, b in zip(sizes, sizes[1:])]
        best, where, ids = model.pooled(local, vectors, places=True)
        hidden = np.maximum(best + model.bias, 0)
        z = hidden @ model.out + model.shift
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[picked]) / len(picked)
        d_hidden = np.outer(g, model.out) * (hidden > 0)
        grads = [np.zeros_like(f) for f in model.filters]
        ids = np.concatenate([ids, np.zeros(2, np.int64)])
        pull = np.zeros_like(vectors)
        for j, (w, f) in enumerate(zip(WIDTHS, model.filters)):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            at, d = where[:, own], d_hidden[:, own]
            for i in range(w):
                here = ids[at + i]
                grads[j][i] = np.einsum("bf,bfs->sf", d, vectors[here])
                np.add.at(pull, here.ravel(), (d[:, :, None] * f[i].T[None]).reshape(-1, SIZE))
        moved = np.flatnonzero(np.abs(pull).sum(1))
        moved = moved[moved > 0]
        if len(moved):
            index, n = _gather(words[moved], rows, starts, counts)
            sums = np.repeat(pull[moved] / n[:, None], n, axis=0)
            rows_of, at = np.unique(index, return_inverse=True)
            total = np.zeros((len(rows_of), SIZE), np.float32)
            np.add.at(total, at, sums)
            seen[0][rows_of] += total**2
            model.table[rows_of] -= rate * total / np.sqrt(seen[0][rows_of])
        for weight, total, grad in zip(weights[1:], seen[1:], [*grads, d_hidden.sum(0), hidden.T @ g]):
            total += grad**2
            weight -= rate * grad / np.sqrt(total)
        shift_seen += g.sum() ** 2
        model.shift -= float(rate * g.sum() / np.sqrt(shift_seen))
    return np.flatnonzero((seen[0] != np.float32(1e-2)).any(axis=1))


def _calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic fit of labels on logits that n rows have each, weighed so that label 1 has its share; targets smoothed, so separable rows stay finite."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    z, y, n = z.astype(np.float64), y.astype(np.float64), n.astype(np.float64)
    ones, rows = (n * y).sum(), n.sum()
    w = n * np.where(y == 1, share * rows / ones, (1 - share) * rows / (rows - ones))
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (rows - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (p - target), w * p * (1 - p) + 1e-6 * n
        jac = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(jac, [(g * z).sum(), g.sum()])
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
    return (a, b) if a > 0 else (1.0, 0.0)


def thresholds(scores: np.ndarray, labels: np.ndarray, n: np.ndarray, languages: list) -> dict[str, float]:
    """For each language with both labels the threshold of best F1 on the given rows, n of each; of equal ones the middle."""
    out = {}
    for lang in {x for x in languages if x is not None}:
        own = np.array([x == lang for x in languages])
        s, y, k = scores[own], labels[own], n[own]
        if len(set(y)) == 2:
            grid = np.linspace(0.05, 0.95, 91)
            f1 = np.array([2 * (k * ((s >= t) & (y == 1))).sum() / max(1, (k * (s >= t)).sum() + (k * y).sum()) for t in grid])
            out[lang] = round(float(np.median(grid[f1 == f1.max()])), 4)
    return out


def documents_with(rows: DataFrame) -> np.ndarray:
    """How many rows (y, text) of each class have each row of the embedding table in a word of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(), np.zeros((2, ROWS), np.int64)
        flat = reader.flat()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                if len(reader.known) > REMEMBERED:
                    reader.clear()
                    flat = reader.flat()
                group = [np.unique(reader(t)) for t in texts[k : k + 500]]
                flat = tuple(map(np.concatenate, zip(flat, reader.flat(len(flat[1])))))
                starts = np.cumsum(flat[1]) - flat[1]
                for d, label in zip(group, batch.column(0).slice(k, 500).to_pylist()):
                    seen[label][np.unique(_gather(d, flat[0], starts, flat[1])[0])] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(c[some], pa.int64()) for c in seen)], ["row", "n0", "n1"])

    # One row for each row of the table at most.
    found = rows.select("y", "text").mapInArrow(run, "row long, n0 long, n1 long").groupBy("row").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, ROWS), np.int64)
    seen[:, found["row"].to_numpy()] = [found["n0"].to_numpy(), found["n1"].to_numpy()]
    return seen


def trained(rows: DataFrame, model: TextCnn, shards: int) -> TextCnn:
    """The model after all shards of rows (key, y, text) have been gone through."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"v{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            own = copy.deepcopy(shared.value)
            moved = fit(own, ids, np.array(labels, np.int64), reader, seed=shard)
            others = np.concatenate([*(f.ravel() for f in own.filters), own.bias, own.out, [own.shift]])
            others = np.concatenate([others, np.zeros(-len(others) % SIZE)]).reshape(-1, SIZE)
            values = np.rint(np.concatenate([own.table[moved], others]).astype(np.float64) / WEIGHT_UNIT).astype(np.int64)
            at = np.concatenate([moved, ROWS + np.arange(len(others))])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(values[:, k], pa.int64()) for k in range(SIZE))], ["row", *names])

        shard, reader, ids, labels = None, Reader(), [], []
        for batch in batches:
            for at, label, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at != shard:
                    if ids:
                        yield emit()
                    shard, reader, ids, labels = at, Reader(), [], []
                ids.append(reader(text).astype(np.int32))
                labels.append(label)
        if ids:
            yield emit()

    dealt = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int").alias("shard"), "y", "text", "key")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "text", "y").select("shard", "y", "text")
    sums = [F.sum(c).alias(c) for c in names]
    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ["row", *names])).groupBy("row").agg(F.count(F.lit(1)).alias("n"), *sums).toArrow()
    at = found["row"].to_numpy()
    values = np.stack([found[c].to_numpy() for c in names], axis=1) * WEIGHT_UNIT / found["n"].to_numpy()[:, None]
    out = copy.deepcopy(model)
    own = at < ROWS
    out.table[at[own]] = values[own]
    rest = values[~own][np.argsort(at[~own])].ravel()
    for weight in [*out.filters, out.bias, out.out]:
        weight[...], rest = rest[: weight.size].reshape(weight.shape), rest[weight.size :]
    out.shift = float(rest[0])
    return out


def labelled(docs: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """The rows of docs (doc, ..) whose id is one of known's, total in number, and about one in seventy of the others: by a Bloom filter of 16 to 32 bits an id, so that a join shuffles few texts in vain."""
    bits = 1 << max(BLOCK.bit_length() - 1, (16 * total - 1).bit_length())
    places = [F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(bits)) for seed in (1, 2)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column(0).to_numpy())
            for part in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1):
                if len(part):
                    own.setdefault(int(part[0]) // BLOCK, np.zeros(BLOCK, bool))[part % BLOCK] = True
        packed = pa.array([np.packbits(b).tobytes() for b in own.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), packed], ["block", "bits"])

    at = known.select(F.explode(F.array(*places)).alias("at"))
    dealt = at.repartition(max(common.partitions(docs.sparkSession), 1), F.floor(F.col("at") / BLOCK))
    filled = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for r in dealt.mapInArrow(blocks, "block long, bits binary").collect():
        filled[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled.ravel())

    @F.arrow_udf("boolean")
    def maybe(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        have = shared.value
        return pa.array((have[x >> 3] >> (7 - (x & 7)) & have[y >> 3] >> (7 - (y & 7)) & 1).astype(bool))

    return docs.where(maybe(*places))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", doc: str = "doc_id", lang: str | None = "lang", label: str = "toxic", sample: int | None = None, threshold: float = 0.3) -> tuple[TextCnn, dict[str, float]]:
    """A model and thresholds by language, from all allowed labelled rows (with sample: from those of that many ids of each class, of smallest hash)."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("doc")).agg(F.max(label).cast("int").alias("y")).where(allowed)
    known = common.materialise(known.withColumn("key", F.xxhash64("doc", F.lit(11))), "toxic-labels")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return TextCnn(constant=0.0), {}
    share = counts.get(1, 0) / total
    if sample is not None:
        known = functools.reduce(DataFrame.unionByName, (known.where(F.col("y") == value).orderBy("key", "doc").limit(sample) for value in counts))
    language = F.col(lang) if lang else F.lit(None).cast("string")
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), language.cast("string").alias("lang"))
    texts = labelled(texts, known, total).join(known.hint("merge"), "doc")
    rows = common.materialise(texts.select("key", "y", "text", "lang", (F.pmod("key", F.lit(5)) == 0).alias("kept_out")), "toxic-rows")
    common.release(docs.sparkSession)
    sizes = rows.where("not kept_out").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars")).collect()
    if len(sizes) < 2:
        return TextCnn(constant=share), {}
    training = rows.where("not kept_out")
    n = np.array([r["n"] for r in sorted(sizes, key=lambda r: r["y"])])
    shards = max(-(-int(n.sum()) // SHARD_ROWS), -(-sum(r["chars"] for r in sizes) // SHARD_CHARS))
    model = trained(training, started(_log_odds(documents_with(training), n)), shards)
    units = F.round(F.col("score") / LOGIT_UNIT).cast("long").alias("z")
    kept = score(rows.where("kept_out"), model, doc="key", also=("y", "lang"), logits=True).groupBy(units, "y", "lang").agg(F.count(F.lit(1)).alias("n")).toArrow()
    z, y, n = kept["z"].to_numpy() * LOGIT_UNIT, kept["y"].to_numpy(), kept["n"].to_numpy()
    model.scale = _calibrated(z, y, n, share)
    return model, thresholds(model.scaled(z), y, n, kept["lang"].to_pylist())


def score(docs: DataFrame, model: TextCnn, text: str = "text", doc: str = "doc_id", also: tuple[str, ...] = (), logits: bool = False) -> DataFrame:
    """(doc, score) of each row. also: columns of docs that come along; the score doesn't see them. logits: give those instead, before the scale."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Reader()
        vectors = np.zeros((1, SIZE), np.float32)
        for batch in batches:
            scores: list[np.ndarray] = []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                if len(reader.known) > REMEMBERED:
                    reader.clear()
                    vectors = np.zeros((1, SIZE), np.float32)
                group = [reader(t) for t in texts[k : k + 500]]
                if len(reader.known) > len(vectors):
                    vectors = np.concatenate([vectors, model.vectors(*reader.flat(len(vectors)))])
                scores.append(model.logits(group, vectors).astype(np.float64) if logits else model.scores(group, vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc", *also, "score"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), *also)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc", *also))
    return rows.mapInArrow(run, f"{kinds}, score double")


def remainder(doc: Column) -> Column:
    return F.crc32(doc.cast("string").cast("binary")) % 4


def op9(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """The contract's columns, and beside them the language's threshold (the contract's where a language has none) and what it would say."""
    docs = common.table(spark, sf_dir, "documents")
    model, by_language = learn(docs, common.table(spark, sf_dir, "labels"), remainder(F.col("doc")) != 2, threshold=threshold)
    rows = score(docs, model, also=("lang",))
    own = F.lit(threshold)
    for lang, t in sorted(by_language.items()):
        own = F.when(F.col("lang") == lang, F.lit(t)).otherwise(own)
    return rows.select(
        F.col("doc").alias("doc_id"),
        (F.coalesce(remainder(F.col("doc")), F.lit(0)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        own.alias("language_threshold"),
        (F.col("score") >= own).cast("int").alias("language_predicted"),
    )
