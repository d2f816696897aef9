"""Tensors whose elements are matrices, of sizes that differ from place to place.

An element is a struct of rows, columns, values and their places (row-major): all values where at least half of them aren't zero (places: null), else those that aren't. Its algebra multiplies by matrix product, in Arrow batches, and adds up elements of one size: tasks add
what goes to the same place as long as that fits BYTES, and what they hold is shuffled by place and added up in order, so no place's elements meet in one
task at once. einsum(.., algebra=MATRICES) takes such tensors as it takes numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebras import Algebra
from .tensor import Tensor

ELEMENT = "struct<rows:int,columns:int,values:array<double>,at:array<bigint>>"
_FIELDS = "rows int, columns int, values array<double>, at array<bigint>"
#: Sums that a task holds before it passes them on.
BYTES = 64 << 20
#: Products of entries that are expanded at once where an element isn't stored whole.
EXPANDED = 1 << 20

#: Rows, columns, values, places (None: all).
Element = tuple[int, int, np.ndarray, np.ndarray | None]


def _chosen(x: Element) -> Element:
    """The smaller storage: all places if half of them hold a value."""
    rows, columns, v, at = x
    if at is None:
        kept = np.flatnonzero(v)
        return x if 2 * len(kept) >= rows * columns else (rows, columns, v[kept], kept)
    if 2 * len(at) < rows * columns:
        return x
    whole = np.zeros(rows * columns)
    whole[at] = v
    return rows, columns, whole, None


def _entries(x: Element) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places and their values, without zeros of elements stored whole."""
    at = np.flatnonzero(x[2]) if x[3] is None else x[3]
    return at, x[2][at] if x[3] is None else x[2]


def _added(at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of equal places added up, places ascending."""
    at, of = np.unique(at, return_inverse=True)
    return at, np.bincount(of, v, len(at))


def _sum(x: Element, y: Element) -> Element:
    if x[3] is None and y[3] is None:
        return (*x[:2], x[2] + y[2], None)
    (i, v), (j, w) = _entries(x), _entries(y)
    return _chosen((*x[:2], *_added(np.concatenate([i, j]), np.concatenate([v, w]))[::-1]))


def _product(x: Element, y: Element) -> Element:
    (m, k, _, _), (_, n, _, _) = x, y
    if x[3] is None and y[3] is None:
        return _chosen((m, n, (x[2].reshape(m, k) @ y[2].reshape(k, n)).ravel(), None))
    # Each entry of x meets the entries in its column's row of y.
    (i, v), (j, w) = _entries(x), _entries(y)
    row = j // n
    low, high = np.searchsorted(row, i % k, "left"), np.searchsorted(row, i % k, "right")
    ends = np.cumsum(high - low)
    at, total, first = np.zeros(0, np.int64), np.zeros(0), 0
    while first < len(i):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + EXPANDED)))
        count = (high - low)[first:last]
        own = np.repeat(np.arange(first, last), count)
        other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[first:last], count)
        at, total = _added(np.concatenate([at, i[own] // k * n + j[other] % n]), np.concatenate([total, v[own] * w[other]]))
        first = last
    return _chosen((m, n, total, at))


def _products(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    out: list[Element] = []
    for x, y in zip(_structs(a), _structs(b)):
        if x[1] != y[0]:
            raise ValueError(f"elements of {x[0]} x {x[1]} and {y[0]} x {y[1]} don't multiply")
        out.append(_product(x, y))
    return pd.DataFrame(out, columns=["rows", "columns", "values", "at"])


def _structs(a: pd.DataFrame) -> Iterator[Element]:
    for rows, columns, values, at in zip(a["rows"], a["columns"], a["values"], a["at"]):
        yield int(rows), int(columns), np.asarray(values, float), None if at is None else np.asarray(at, np.int64)


def times(a: Column, b: Column) -> Column:
    """The matrix product of two elements."""
    return F.pandas_udf(_products, _FIELDS)(a, b)


def _batch(keys: Sequence[str], held: list[tuple[tuple, Element]]) -> pa.RecordBatch:
    columns = [pa.array([at[k] for at, _ in held], pa.int64()) for k in range(len(keys))]
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for _, x in held], kind) for k, kind in enumerate(kinds))], [*keys, "rows", "columns", "values", "at"])


def _elements(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Element]]:
    """(place, element) of rows of n keys and an element's fields."""
    for b in batches:
        of = [b.column(k).to_pylist() for k in range(n)]
        rows, columns, values, at = b.column(n).to_pylist(), b.column(n + 1).to_pylist(), b.column(n + 2), b.column(n + 3)
        for k in range(len(b)):
            yield tuple(c[k] for c in of), (rows[k], columns[k], values[k].values.to_numpy(zero_copy_only=False), at[k].values.to_numpy(zero_copy_only=False) if at[k].is_valid else None)


def _bytes(x: Element) -> int:
    return x[2].nbytes + (0 if x[3] is None else x[3].nbytes)


def summed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements (keys, v) of equal keys added up; they must be of one size."""
    n, schema = len(keys), ", ".join([*(f"{k} bigint" for k in keys), _FIELDS])

    def both(place: tuple, a: Element, b: Element) -> Element:
        if a[:2] != b[:2]:
            raise ValueError(f"elements of {a[0]} x {a[1]} and {b[0]} x {b[1]} at {place} don't add up")
        return _sum(a, b)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Element] = {}
        size = 0
        for place, x in _elements(batches, n):
            size -= _bytes(held[place]) if place in held else 0
            held[place] = both(place, held[place], x) if place in held else x
            size += _bytes(held[place])
            if size > BYTES:
                yield _batch(keys, list(held.items()))
                held, size = {}, 0
        if held:
            yield _batch(keys, list(held.items()))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, out, size = None, None, [], 0
        for place, x in _elements(batches, n):
            if held == place:
                total = both(place, total, x)
                continue
            if total is not None:
                out.append((held, total))
                size += _bytes(total)
                if size > BYTES:
                    yield _batch(keys, out)
                    out, size = [], 0
            held, total = place, x
        if total is not None:
            yield _batch(keys, [*out, (held, total)])

    flat = df.select(*keys, "v.rows", "v.columns", "v.values", "v.at").mapInArrow(within, schema)
    placed = flat.repartition(*keys).sortWithinPartitions(*keys) if keys else flat.coalesce(1)
    return placed.mapInArrow(across, schema).select(*keys, F.struct("rows", "columns", "values", "at").alias("v"))


#: Elements that are matrices: matrix product, and sums place by place.
MATRICES = Algebra("matrices", None, times, commutative=False, summed=summed)


def gathered(entries: DataFrame, heights: DataFrame, widths: DataFrame, shape: Sequence[int]) -> Tensor:
    """A matrix of elements from entries (i0, i1, p, q, v): the value at row p and column q of element (i0, i1). heights (i0, rows) and widths (i1, columns) give the sizes; places of an element without an entry are zero, and repeated ones are added."""
    rows = entries.join(heights, "i0").join(widths, "i1").select("i0", "i1", "rows", "columns", F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q"), F.col("v").cast("double").alias("v"))
    ordered = rows.repartition("i0", "i1").sortWithinPartitions("i0", "i1")
    keys = ["i0", "i1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, parts = None, (0, 0), []

        def whole() -> pa.RecordBatch:
            places, values = _added(*(np.concatenate(x) for x in zip(*parts)))
            return _batch(keys, [(held, _chosen((*size, values, places)))])

        for b in batches:
            i, j, r, c, p, q, v = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), len(i)] if len(i) else []
            for start, end in zip(cuts, cuts[1:]):
                at = (int(i[start]), int(j[start]))
                if at != held:
                    if held is not None:
                        yield whole()
                    held, size, parts = at, (int(r[start]), int(c[start])), []
                parts.append((p[start:end] * size[1] + q[start:end], v[start:end]))
        if held is not None:
            yield whole()

    made = ordered.mapInArrow(run, f"i0 bigint, i1 bigint, {_FIELDS}")
    return Tensor(made.select("i0", "i1", F.struct("rows", "columns", "values", "at").alias("v")), shape, "float64", MATRICES)


def scattered(t: Tensor) -> DataFrame:
    """(i0 .., p, q, v): a row for each value of each element that is stored."""
    every = F.when(F.size("v.values") > 0, F.sequence(F.lit(0).cast("bigint"), F.size("v.values").cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    flat = t.df.select(*t.keys, F.col("v.columns").alias("columns"), F.explode(F.arrays_zip(F.coalesce("v.at", every).alias("at"), F.col("v.values").alias("v"))).alias("x")).select(*t.keys, "columns", "x.at", "x.v")
    return flat.select(*t.keys, F.expr("at div columns").cast("bigint").alias("p"), F.expr("at % columns").cast("bigint").alias("q"), "v")
