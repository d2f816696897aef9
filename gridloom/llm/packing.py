"""Best-fit packing by sum of squares: documents, tokenised and cut, into sequences of fixed capacity.

With N(g) open sequences of residual gap g, a piece goes where the sum of N(g) squared becomes smallest; of equal
places the tightest. An open sequence with room is used even where a new one alone would make the sum smaller, as the
fewest sequences are asked for: then the tightest. Pieces come longest first. Which piece of a length goes where doesn't
matter, so the packing is found on the histogram of lengths (at most `capacity` numbers, whatever the corpus): the
pieces of a length are placed one by one up to `steps` of them, and beyond in steps of that share of their count, so that the driver's work
doesn't grow with the corpus; sequences with equal contents are kept as one run. What each length's pieces get is a
table of slots, of at most steps x capacity; every piece then finds its slot by its rank among the pieces of its length,
which is worked out in buckets so that no length, however common, meets in one task.

Defined results: a null text is an empty document (the end id alone); every row is a document of its own, repeated ids
and texts too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .tokens import library_encoder

BUCKETS = 256
STEPS = 256
PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, text: str, doc: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(uid, doc, piece, start, length, ids_crc32) of every piece; uid is unique once written."""
    step, end = capacity * 4, np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t or "") + end
                first = (len(ids) - 1) % step + 1
                cuts = [0, *range(first, len(ids) + 1, step)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    out.append((k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, {PIECE}").withColumn("uid", F.monotonically_increasing_id())


def sum_of_squares(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in order, number of sequences with them) that hold every piece of the histogram."""
    n = np.zeros(capacity + 1, np.int64)
    runs: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        quantum = max(1, -(-left // steps))
        while left:
            own = n[s:]
            # The change of the sum when a sequence of gap g gets a gap of g - s; full ones no longer count.
            change = 2 * (n[: capacity - s + 1] - own) + 2
            change[0] = 1 - 2 * own[0]
            change = np.where(own > 0, change, np.iinfo(np.int64).max)
            best = int(np.argmin(change))
            fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
            if own[best] and change[best] <= max(fresh, 0):
                g, count = best + s, min(left, quantum, int(own[best]))
            elif own.any() and s < capacity:
                # Only a new sequence would be better for the sum; the gaps are there, so the tightest is used.
                g = int(np.argmax(own > 0)) + s
                count = min(left, quantum, int(n[g]))
            else:
                g, count = capacity, min(left, quantum)
            left -= count
            rest = g - s
            if g == capacity:
                taken = [((), count)]
            else:
                n[g] -= count
                taken, need = [], count
                while need:
                    pattern, k = runs[g].pop()
                    use = min(k, need)
                    taken.append((pattern, use))
                    if k > use:
                        runs[g].append((pattern, k - use))
                    need -= use
            n[rest] += count if rest else 0
            for pattern, k in taken:
                new = (*pattern, s)
                if runs[rest] and runs[rest][-1][0] == new:
                    runs[rest][-1] = (new, runs[rest][-1][1] + k)
                else:
                    runs[rest].append((new, k))
    return [r for own in runs for r in own]


def slots(runs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first rank), first sequence and offset of each run of slots."""
    used: dict[int, int] = {}
    key, first, offset, sequence = [], [], [], 0
    for pattern, count in runs:
        at = 0
        for s in pattern:
            key.append(s << 40 | used.get(s, 0))
            first.append(sequence)
            offset.append(at)
            used[s] = used.get(s, 0) + count
            at += s
        sequence += count
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (key, first, offset))


def pack(docs: DataFrame, text: str = "text", doc: str = "doc_id", tokenizer: str = "byte_bpe_50k.tiktoken", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    rows = common.materialise(pieces(docs, text, doc, tokenizer, capacity, end_id), "pieces")
    full = rows.where(F.col("length") == capacity).select("doc", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int"))
    counts = common.materialise(rest.groupBy("bucket", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(sum_of_squares(histogram, capacity)))
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", "length", before.alias("before"))
    place = F.row_number().over(W.partitionBy("bucket", "length").orderBy("uid")) - 1
    ranked = rest.withColumn("place", place).join(starts, ["bucket", "length"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = table.value
        for batch in batches:
            at = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64) << 40 | batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(key, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[k] + at - key[k]), pa.array(offset[k])], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc"].dataType.simpleString()
    return full.unionByName(ranked.mapInArrow(run, f"doc {kind}, {PIECE}, sequence_id long, offset long"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
