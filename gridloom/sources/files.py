"""Tensors in files: coordinate text, raw binary, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import types
from ..functions.algebras import ring
from ..operators.tensor import V, Tensor
from . import raw
from .checkpoint import checkpointed

#: Element types of coordinate text.
TEXT = ("int32", "int64", "float32", "float64")


def read_text(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64", with_values: bool = True) -> Tensor:
    """Lines `i1 .. ik [v]`, 0-based, apart by white space; without values each line counts one. Equal places are summed; blank lines don't count."""
    if dtype not in TEXT:
        raise TypeError(f"text holds {TEXT}")
    n = len(shape)
    bare = F.btrim("value", F.lit(" \t\r\x0b\x0c"))
    lines = spark.read.text(path).where(bare != "").select(F.split(bare, r"\s+").alias("p"))
    v = F.element_at("p", n + 1).cast(types.SQL[dtype]) if with_values else F.lit(1).cast(types.SQL[dtype])
    rows = lines.select(*(F.element_at("p", k + 1).cast("bigint").alias(f"i{k}") for k in range(n)), v.alias("v"))
    df = rows.groupBy(*(f"i{k}" for k in range(n))).agg(F.sum("v").cast(types.SQL[dtype]).alias("v"))
    return Tensor(df, shape, dtype)


def write_text(t: Tensor, path: str, with_values: bool = True) -> None:
    """Entries other than zero, a line each."""
    columns = [*t.keys, "v"] if with_values else t.keys
    t.df.where(V() != 0).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def read_binary(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64") -> Tensor:
    """Files of raw values in row-major order, named so that they sort in order; each file is one task's, their starts come from the lengths before."""
    size = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path)
    complex_ = types.is_complex(dtype)
    # One row for each file, numbered in order of names; starts are running sums of lengths.
    order = W.orderBy("path")
    starts = files.select("path", "length").withColumn("start", F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / size)
    starts = checkpointed(starts)
    total = (starts.agg(F.sum("length")).first()[0] or 0) // size
    if total != int(np.prod(shape)):
        raise ValueError(f"{total} values for shape {tuple(shape)}")

    def run(batches):
        for b in batches:
            for content, start in zip(b["content"], b["start"]):
                v = np.frombuffer(content, dtype)
                # In parts, so that a large file isn't unpacked at once.
                for k in range(0, len(v), 1 << 18):
                    part = v[k : k + (1 << 18)]
                    index = np.unravel_index(np.arange(len(part)) + (int(start) + k), tuple(shape))
                    values = {"re": part.real.astype(float), "im": part.imag.astype(float)} if complex_ else {"v": part}
                    yield pd.DataFrame({**{f"i{k}": x for k, x in enumerate(index)}, **values})

    kinds = "re double, im double" if complex_ else f"v {types.SQL[dtype]}"
    df = files.select("path", "content").join(starts.select("path", "start"), "path").select("content", "start").mapInPandas(run, ", ".join([*(f"i{k} bigint" for k in range(len(shape))), kinds]))
    if complex_:
        df = df.select(*(f"i{k}" for k in range(len(shape))), F.struct("re", "im").alias("v"))
    return Tensor(df, shape, dtype, None, False)


def write_binary(t: Tensor, path: str, block: int = 1 << 20) -> None:
    """Raw values in row-major order as files part-00000000.bin, ..: read_binary reads them, and so does whatever reads one after the other. Tasks pack blocks of places and write them; no value passes through the driver."""
    dense, dtype = t.densify(), t.dtype
    rows = dense.df.select(dense.linear().alias("at"), "v").withColumn("block", F.expr(f"at div {block}"))

    def packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("at")["v"]
        if types.is_complex(dtype):
            values = np.array([complex(x["re"], x["im"]) for x in values])
        return pd.DataFrame({"block": [key[0]], "content": [np.asarray(values).astype(dtype).tobytes()]})

    raw.write_blocks(rows.groupBy("block").applyInPandas(packed, "block bigint, content binary"), path)


#: Whole tensors as checkpoints: dense ones raw, sparse ones as coordinate text.
def save(t: Tensor, path: str) -> None:
    write_text(t, path) if t.sparse else write_binary(t, path)


def restore(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64", sparse: bool = False) -> Tensor:
    return read_text(spark, path, shape, dtype) if sparse else read_binary(spark, path, shape, dtype)


def to_block_cyclic(t: Tensor, blocks: tuple[int, int], grid: tuple[int, int]) -> DataFrame:
    """(p, q, i, j, v): a matrix as a 2-D block-cyclic exchange format lays it out: each entry's process row and column, and its local row and column there."""
    (bm, bn), (pm, pn) = blocks, grid
    place = lambda k, b, p: (F.expr(f"(i{k} div {b}) % {p}"), F.expr(f"(i{k} div {b * p}) * {b} + i{k} % {b}"))
    (p, i), (q, j) = place(0, bm, pm), place(1, bn, pn)
    return t.df.select(p.alias("p"), q.alias("q"), i.alias("i"), j.alias("j"), "v")


def from_block_cyclic(rows: DataFrame, shape: Sequence[int], blocks: tuple[int, int], grid: tuple[int, int], dtype: str = "float64") -> Tensor:
    """The inverse of to_block_cyclic()."""
    (bm, bn), (pm, pn) = blocks, grid
    whole = lambda p, i, b, n: F.expr(f"(({i} div {b}) * {n} + {p}) * {b} + {i} % {b}").cast("bigint")
    return Tensor(rows.select(whole("p", "i", bm, pm).alias("i0"), whole("q", "j", bn, pn).alias("i1"), "v"), shape, dtype)


def to_csr(t: Tensor) -> DataFrame:
    """(i0, columns, v): a sparse matrix by compressed rows, those without entries left out (as hypersparse formats do)."""
    pairs = F.sort_array(F.collect_list(F.struct("i1", "v")))
    packed = t.df.groupBy("i0").agg(pairs.alias("p"))
    return packed.select("i0", F.transform("p", lambda x: x["i1"]).alias("columns"), F.transform("p", lambda x: x["v"]).alias("v"))


def from_csr(rows: DataFrame, shape: Sequence[int], dtype: str = "float64") -> Tensor:
    flat = rows.select("i0", F.explode(F.arrays_zip(F.col("columns").alias("i1"), F.col("v").alias("v"))).alias("x"))
    return Tensor(flat.select("i0", F.col("x.i1").cast("bigint").alias("i1"), "x.v"), shape, dtype)


def csr_times_dense(rows: DataFrame, b: Tensor, height: int) -> Tensor:
    """Compressed rows times a dense matrix: each stored column meets a whole row of it."""
    from ..operators.linalg import from_rows, rows_of

    n = b.shape[1]
    flat = rows.select("i0", F.explode(F.arrays_zip(F.col("columns").alias("i1"), F.col("v").alias("w"))).alias("x")).select("i0", "x.i1", "x.w")
    met = flat.join(rows_of(b).select(F.col("i0").alias("i1"), "row"), "i1").select("i0", F.transform("row", lambda x: x * F.col("w")).alias("row"))
    if n <= 256:
        # A sum for each column combines before the shuffle.
        sums = met.groupBy("i0").agg(*(F.sum(F.get("row", F.lit(k))).alias(f"c{k}") for k in range(n))).select("i0", F.array(*(f"c{k}" for k in range(n))).alias("row"))
        return from_rows(sums, (height, n))
    sums = met.select("i0", F.posexplode("row").alias("i1", "v")).groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    return Tensor(sums.select("i0", F.col("i1").cast("bigint").alias("i1"), "v"), (height, n))


def read_parquet(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64", unique: bool = True) -> Tensor:
    df = spark.read.parquet(path)
    keys = [f"i{k}" for k in range(len(shape))]
    if not unique:
        df = df.groupBy(*keys).agg(ring(dtype).plus(V()).alias("v"))
    return Tensor(df.select(*keys, "v"), shape, dtype)


def write_parquet(t: Tensor, path: str) -> None:
    t.df.write.mode("overwrite").parquet(path)
