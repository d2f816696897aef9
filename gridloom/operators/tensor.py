"""The tensor handle: shape, element type, algebra and a coordinate relation (i0.., v).

Values are immutable; what changes a tensor elsewhere gives a new one here. A position without a row holds the algebra's
zero. `sparse` says how functions with f(0) != 0 see those positions: a dense tensor is filled in first, a sparse one
has only its stored entries visited.

A tensor with a symmetry (`sym`: kind and its two modes) has half of its rows in `stored`; `df`, which all operators
read, gives all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise, types
from ..functions.algebras import Algebra, ring
from ..plans import planner, statistics, subscripts



#: Share of places with an entry up to which random places are drawn; above it every place is asked.
SPARSE = 0.1


def V() -> Column:
    return F.col("v")


def schema(order: int, dtype: str) -> str:
    return ", ".join([*(f"i{k} bigint" for k in range(order)), f"v {types.SQL[dtype]}"])


def _letters(n: int, skip: str = "") -> str:
    found = [c for c in map(chr, range(97, 123)) if c not in skip] + [c for c in map(chr, range(0x3B1, 0x3B1 + 400)) if c not in skip]
    return "".join(found[:n])


class Tensor:
    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64", algebra: Algebra | None = None, sparse: bool = True, rows: float | None = None, sym: tuple[str, int, int] | None = None):
        self.stored, self.shape, self.dtype, self.sparse = df, tuple(int(n) for n in shape), dtype, sparse
        self.algebra = algebra or ring(dtype)
        self.rows = float(rows if rows is not None else prod(self.shape))
        self.sym = sym
        self.name = ""
        self.statistics = None

    @property
    def df(self) -> DataFrame:
        """All rows; of a tensor with a symmetry the ones not stored too."""
        if self.sym is None:
            return self.stored
        from .symmetry import unpacked

        return unpacked(self)

    # Building

    @classmethod
    def from_df(cls, df: DataFrame, dims: Sequence[str | Column], value: str | Column | None, shape: Sequence[int], dtype: str = "float64", algebra: Algebra | None = None, rows: float | None = None) -> Tensor:
        """Columns of a table as coordinates and value (None: the algebra's one); values of equal coordinates are summed."""
        algebra = algebra or ring(dtype)
        v = types.literal(algebra.one, dtype) if value is None else (F.col(value) if isinstance(value, str) else value).cast(types.SQL[dtype])
        at = [(F.col(d) if isinstance(d, str) else d).cast("bigint").alias(f"i{k}") for k, d in enumerate(dims)]
        keys = [f"i{k}" for k in range(len(at))]
        flat = df.select(*at, v.alias("v")).where(F.col("v").isNotNull())
        for k in keys:
            flat = flat.where(F.col(k).isNotNull())
        return cls(flat.groupBy(*keys).agg(algebra.plus(V()).alias("v")), shape, dtype, algebra, True, rows)._typed(dtype)

    @classmethod
    def from_unique(cls, df: DataFrame, dims: Sequence[str | Column], value: str | Column | None, shape: Sequence[int], dtype: str = "float64", algebra: Algebra | None = None, rows: float | None = None) -> Tensor:
        """As from_df for coordinates known to be unique: no shuffle."""
        algebra = algebra or ring(dtype)
        v = types.literal(algebra.one, dtype) if value is None else (F.col(value) if isinstance(value, str) else value).cast(types.SQL[dtype])
        return cls(df.select(*((F.col(d) if isinstance(d, str) else d).cast("bigint").alias(f"i{k}") for k, d in enumerate(dims)), v.alias("v")), shape, dtype, algebra, True, rows)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array, sparse: bool = False) -> Tensor:
        array = np.asarray(array)
        dtype = array.dtype.name if array.dtype.name in types.SQL else "float64"
        at = np.nonzero(array) if sparse and array.ndim else [x.ravel() for x in np.indices(array.shape)]
        v = (array[at] if sparse and array.ndim else array.ravel()).astype(dtype)
        if not len(v) or (sparse and not array.ndim and not v[0]):
            return cls.zeros(spark, array.shape, dtype, sparse)
        value = pa.StructArray.from_arrays([pa.array(v.real.astype(float)), pa.array(v.imag.astype(float))], ["re", "im"]) if types.is_complex(dtype) else pa.array(v)
        rows = pa.table([*(pa.array(x.astype(np.int64)) for x in at), value], [*(f"i{k}" for k in range(array.ndim)), "v"])
        return cls(spark.createDataFrame(rows, schema(array.ndim, dtype)), array.shape, dtype, None, sparse, len(v))

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int], dtype: str = "float64", sparse: bool = True, algebra: Algebra | None = None) -> Tensor:
        return cls(spark.createDataFrame([], schema(len(shape), dtype)), shape, dtype, algebra, sparse, 0)

    def zeros_like(self) -> Tensor:
        return Tensor.zeros(self.spark, self.shape, self.dtype, False)

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value, dtype: str = "float64", algebra: Algebra | None = None) -> Tensor:
        return cls(grid(spark, shape).withColumn("v", types.literal(value, dtype)), shape, dtype, algebra, False)

    @classmethod
    def ones(cls, spark: SparkSession, shape: Sequence[int], dtype: str = "float64") -> Tensor:
        return cls.full(spark, shape, 1, dtype)

    @classmethod
    def eye(cls, spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype: str = "float64", sparse: bool = False) -> Tensor:
        """Ones on the k-th diagonal of an n x m matrix (m: n where it isn't given)."""
        m = n if m is None else m
        length = max(0, min(n - max(-k, 0), m - max(k, 0)))
        df = spark.range(length).select((F.col("id") + max(-k, 0)).alias("i0"), (F.col("id") + max(k, 0)).alias("i1"), types.literal(1, dtype).alias("v"))
        return cls(df, (n, m), dtype, None, sparse, length)

    @classmethod
    def arange(cls, spark: SparkSession, start, stop=None, step=1, dtype: str | None = None) -> Tensor:
        if stop is None:
            start, stop = 0, start
        dtype = dtype or ("float64" if any(isinstance(x, float) for x in (start, stop, step)) else "int64")
        n = max(0, ceil((stop - start) / step))
        return cls(spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * F.lit(step)).cast(types.SQL[dtype]).alias("v")), (n,), dtype, None, False, n)

    @classmethod
    def random(cls, spark: SparkSession, shape: Sequence[int], low: float = 0.0, high: float = 1.0, seed: int = 0, dtype: str = "float64", fraction: float | None = None) -> Tensor:
        """Uniform values in [low, high); with a fraction, so large a part of the positions, sparse: up to SPARSE exactly so many places are drawn, else each is one with that probability. Values and places follow from the seed, whatever the partitioning."""
        if fraction is not None and len(shape) and 0 < fraction <= SPARSE:
            return cls._drawn(spark, shape, round(fraction * prod(shape)), low, high, seed, dtype)
        names = [F.col(f"i{k}") for k in range(len(shape))]
        unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *names), 11).cast("double") / F.lit(float(1 << 53))
        df = grid(spark, shape)
        if fraction is not None:
            df = df.where(unit(1) < fraction)
        return cls(df.withColumn("v", _uniform(len(shape), low, high, seed, dtype)), shape, dtype, None, fraction is not None, prod(shape) * (fraction or 1))

    @classmethod
    def _drawn(cls, spark: SparkSession, shape: Sequence[int], count: int, low: float, high: float, seed: int, dtype: str) -> Tensor:
        """count entries at places drawn by a counter, whatever the size of the shape: places drawn again are dropped, and of the others those drawn first stay.

        As many are drawn as leave count different ones with near certainty, and twice as many where they don't. Which are first follows from a histogram of their
        numbers and the order within one of its parts.
        """
        size, parts = float(prod(shape)), 4096
        keys = [f"i{k}" for k in range(len(shape))]
        draws = int(-size * np.log1p(-count / size) + 6 * np.sqrt(count) + 64)
        while True:
            place = [F.pmod(F.xxhash64(F.lit(seed), F.lit(7 + k), "id"), F.lit(n)).cast("bigint").alias(f"i{k}") for k, n in enumerate(shape)]
            width = max(1, draws // parts)
            found = spark.range(draws).select("id", *place).groupBy(*keys).agg(F.min("id").alias("first")).withColumn("part", F.expr(f"first div {width}"))
            sizes = sorted((r["part"], r["count"]) for r in found.groupBy("part").count().collect())
            if sum(n for _, n in sizes) >= count:
                break
            draws *= 2
        last, before = 0, 0
        for last, n in sizes:
            if before + n >= count:
                break
            before += n
        # The part where the count is reached has few entries, so their order is one task's.
        edge = found.where(F.col("part") == last).orderBy("first").limit(count - before)
        df = found.where(F.col("part") < last).unionByName(edge).select(*keys, _uniform(len(shape), low, high, seed, dtype).alias("v"))
        return cls(df, shape, dtype, None, True, count)

    # Parts and plumbing

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def itemsize(self) -> int:
        return np.dtype(self.dtype).itemsize

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(self.itemsize * prod(self.shape[k + 1 :]) for k in range(self.ndim))

    @property
    def keys(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    def _with(self, df: DataFrame, shape: Sequence[int] | None = None, dtype: str | None = None, sparse: bool | None = None, rows: float | None = None) -> Tensor:
        dtype = dtype or self.dtype
        algebra = self.algebra if dtype == self.dtype else ring(dtype)
        return Tensor(df, self.shape if shape is None else shape, dtype, algebra, self.sparse if sparse is None else sparse, self.rows if rows is None else rows)

    def _typed(self, dtype: str) -> Tensor:
        return self if types.is_complex(dtype) or self.df.schema["v"].dataType.typeName() == "struct" else self._with(self.df.withColumn("v", V().cast(types.SQL[dtype])), dtype=dtype)

    def linear(self) -> Column:
        """Row-major place of a row."""
        at = F.lit(0).cast("bigint")
        for k, n in enumerate(self.shape):
            at = at * F.lit(n) + F.col(f"i{k}")
        return at

    def copy(self) -> Tensor:
        return self._with(self.df)

    def to_numpy(self) -> np.ndarray:
        out = np.full(self.shape, 0 if self.algebra.zero is None else self.algebra.zero, self.dtype)
        rows = self.df.toArrow()
        v = rows.column("v").combine_chunks()
        v = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False) if types.is_complex(self.dtype) else v.to_numpy(zero_copy_only=False)
        if len(v):
            out[tuple(rows.column(k).to_numpy() for k in self.keys)] = v if self.ndim else v[0]
        return out

    def item(self):
        if self.size != 1:
            raise TypeError("only tensors of one element have a single value")
        return self.to_numpy().reshape(-1)[0].item()

    def __int__(self) -> int:
        return int(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __bool__(self) -> bool:
        return bool(self.item())

    def nnz(self) -> int:
        return self.df.where(~types.is_zero(V(), self.dtype)).count()

    def pairs(self) -> list[tuple[int, object]]:
        """All entries by row-major place."""
        return [(r["at"], r["v"]) for r in self.df.select(self.linear().alias("at"), "v").orderBy("at").collect()]

    def local(self, nonzero: bool = False) -> DataFrame:
        """Rows with the partition that holds them."""
        rows = self.df.where(~types.is_zero(V(), self.dtype)) if nonzero else self.df
        return rows.withColumn("partition", F.spark_partition_id())

    def distributed(self, n: int, *modes: int) -> Tensor:
        """Partitioned by some modes; tensors partitioned alike join on them without another shuffle."""
        return self._with(self.df.repartition(n, *(f"i{k}" for k in modes)))

    def mapped(self, n: int, *modes: int) -> DataFrame:
        """Rows under a partitioning by some modes, with the partition that holds each."""
        return self.distributed(n, *modes).local()

    @classmethod
    def from_mapped(cls, rows: DataFrame, shape: Sequence[int], dtype: str = "float64") -> Tensor:
        """A tensor from rows that partitions gave; those of equal places are summed."""
        return cls.from_df(rows, [f"i{k}" for k in range(len(shape))], "v", shape, dtype)

    def split(self, parts: int, axis: int = 0) -> list[Tensor]:
        """Slices of about equal length along a mode; stack() puts them together again."""
        n = self.shape[axis]
        cuts = [n * k // parts for k in range(parts + 1)]
        return [self[tuple(slice(a, b) if k == axis else slice(None) for k in range(self.ndim))] for a, b in zip(cuts, cuts[1:])]

    def align(self, other: Tensor, n: int | None = None) -> Tensor:
        """Partitioned as the other one is, if its rows are hashed by modes that this tensor has too; else by the modes both have. n: partitions where the other has none of its own."""
        found = planner.partitioning(other.stored)
        modes, count = found if found and all(k < self.ndim for k in found[0]) else (list(range(min(self.ndim, other.ndim))), None)
        return self.distributed(count or n or int(self.spark.conf.get("spark.sql.shuffle.partitions")), *modes)

    def set_zero(self) -> Tensor:
        """No entries, all else alike."""
        return Tensor(self.stored.where("false"), self.shape, self.dtype, self.algebra, self.sparse, 0, self.sym)

    def set_all(self, value) -> Tensor:
        """Every place holds the value; of dense tensors only."""
        if self.sparse:
            raise ValueError("only dense tensors take one value everywhere")
        return Tensor.full(self.spark, self.shape, value, self.dtype, self.algebra)

    def named(self, name: str) -> Tensor:
        """This tensor under a name, which profiling reports and plans show."""
        out = self._with(self.df.alias(name) if name else self.df)
        out.name = name
        return out

    def print_matrix(self) -> str:
        """A matrix as lines of values, zeros filled in."""
        if self.ndim != 2:
            raise ValueError("only matrices print as one")
        return "\n".join(" ".join(map(str, r)) for r in self.to_numpy().tolist())

    def text(self, cutoff: float = 0.0, most: int = 1000) -> str:
        rows = self.df.where(types.absolute(V(), self.dtype) > cutoff).orderBy(*self.keys).limit(most).collect()
        return "\n".join(f"{tuple(r)[:-1]} {r['v']}" for r in rows)

    def compare(self, other: Tensor, cutoff: float = 0.0) -> DataFrame:
        """Places where two tensors differ by more than cutoff."""
        a, b = self._filled_join(other, "both")
        return a.where(types.absolute(types.add(F.col("a"), types.negative(F.col("b"), b), b), b) > cutoff)

    # Index notation

    def i(self, labels: str):
        from .notation import Indexed

        return Indexed(self, labels)

    def leaf(self, labels: str) -> planner.Leaf:
        if len(labels) != self.ndim:
            raise ValueError(f"labels {labels!r} for {self.ndim} dimensions")
        return planner.leaf(self.df, labels, self.rows, self.statistics)

    def analyzed(self) -> Tensor:
        """This tensor with statistics for the planner, from one pass over its rows: their number, and different and frequent indices of each mode."""
        out = Tensor(self.stored, self.shape, self.dtype, self.algebra, self.sparse, self.rows, self.sym)
        out.statistics = statistics.measured(self.df, self.keys) if self.ndim else None
        return out

    # Elementwise

    def map(self, f: Callable[[Column], Column], dtype: str | None = None, moves_zero: bool = False) -> Tensor:
        """f on each value; a dense tensor is filled in first if f moves zero."""
        x = self.densify() if moves_zero and not self.sparse else self
        return x._with(x.df.select(*self.keys, f(V()).alias("v")), dtype=dtype)

    def apply(self, name: str, *arguments) -> Tensor:
        f = getattr(elementwise, name)
        f = f(*arguments) if arguments else f
        x = self.densify() if name in elementwise.MOVES_ZERO and not self.sparse else self
        v, dtype = f(V(), self.dtype)
        return x._with(x.df.select(*self.keys, v.alias("v")), dtype=dtype)

    def exp(self) -> Tensor:
        return self.apply("exp")

    def floor(self) -> Tensor:
        return self.apply("floor")

    def ceil(self) -> Tensor:
        return self.apply("ceil")

    def rint(self) -> Tensor:
        return self.apply("rint")

    def clip(self, low: float | None = None, high: float | None = None) -> Tensor:
        x = self.densify() if not self.sparse or (low or 0) > 0 or (high or 0) < 0 else self
        v, dtype = elementwise.clip(low, high)(V(), self.dtype)
        return x._with(x.df.select(*self.keys, v.alias("v")), dtype=dtype)

    def conj(self) -> Tensor:
        return self.apply("conj")

    def real(self, value: Tensor | None = None) -> Tensor:
        """The real part, or with value this tensor with that real part."""
        return self.apply("real") if value is None else self._parted(value, "re")

    def imag(self, value: Tensor | None = None) -> Tensor:
        return self.apply("imag") if value is None else self._parted(value, "im")

    def _parted(self, value: Tensor, part: str) -> Tensor:
        if not types.is_complex(self.dtype):
            raise TypeError("only complex tensors have parts to set")
        other = value.df.select(*self.keys, V().cast("double").alias("p"))
        zero = types.literal(0, self.dtype)
        df = self.df.join(other, self.keys, "full_outer") if self.ndim else self.df.crossJoin(other)
        v, p = F.coalesce(V(), zero), F.coalesce("p", F.lit(0.0))
        new = F.struct((p if part == "re" else v["re"]).alias("re"), (p if part == "im" else v["im"]).alias("im"))
        return self._with(df.select(*self.keys, new.alias("v")))

    def __abs__(self) -> Tensor:
        return self.apply("absolute")

    def __neg__(self) -> Tensor:
        return self.apply("negative")

    def astype(self, dtype: str, casting: str = "unsafe") -> Tensor:
        if not np.can_cast(np.dtype(self.dtype), np.dtype(dtype), casting):
            raise TypeError(f"can't cast {self.dtype} to {dtype} as {casting}")
        return self._with(self.df.select(*self.keys, types.cast(V(), self.dtype, dtype).alias("v")), dtype=dtype)

    def _broadcast(self, shape: tuple[int, ...]) -> DataFrame:
        """Rows under a larger shape: leading modes are added and modes of length one repeated, by exploding a sequence of known length."""
        lead = len(shape) - self.ndim
        df, names = self.df, []
        for k, n in enumerate(shape):
            own = self.shape[k - lead] if k >= lead else 1
            if own == n and k >= lead:
                names.append(F.col(f"i{k - lead}").alias(f"j{k}"))
            elif own == 1:
                df = planner.repeated(df, f"e{k}", n)
                names.append(F.col(f"e{k}").alias(f"j{k}"))
            else:
                raise ValueError(f"shapes {self.shape} and {shape} don't fit")
        return df.select(*names, "v").toDF(*(f"i{k}" for k in range(len(shape))), "v")

    def _other(self, x) -> Tensor:
        if isinstance(x, Tensor):
            return x
        dtype = np.asarray(x).dtype.name
        weak = types.promote(self.dtype, dtype) if np.dtype(dtype).kind != np.dtype(self.dtype).kind else self.dtype
        return Tensor.full(self.spark, (), x, weak)

    def _pair(self, x, dtype: Callable[[str, str], str] = types.promote) -> tuple[DataFrame, DataFrame, tuple[int, ...], str, Tensor]:
        other = self._other(x)
        shape = np.broadcast_shapes(self.shape, other.shape)
        to = dtype(self.dtype, other.dtype)
        a = self._broadcast(shape).withColumn("v", types.cast(V(), self.dtype, to))
        b = other._broadcast(shape).withColumn("v", types.cast(V(), other.dtype, to))
        return a, b, shape, to, other

    def _merge(self, x, sign: int) -> Tensor:
        a, b, shape, to, other = self._pair(x)
        if sign < 0:
            b = b.withColumn("v", types.negative(V(), to))
        keys = [f"i{k}" for k in range(len(shape))]
        algebra = self.algebra if to == self.dtype and sign > 0 else ring(to)
        df = a.unionByName(b).groupBy(*keys).agg(algebra.plus(V()).alias("v"))
        if not types.is_complex(to):
            df = df.withColumn("v", V().cast(types.SQL[to]))
        return Tensor(df, shape, to, algebra, self.sparse and other.sparse, self.rows + other.rows)

    def _meet(self, x, f: Callable[[Column, Column, str], Column], dtype=types.promote) -> Tensor:
        a, b, shape, to, other = self._pair(x, dtype)
        keys = [f"i{k}" for k in range(len(shape))]
        right = b.withColumnRenamed("v", "w")
        joined = a.join(right, keys) if keys else a.crossJoin(right)
        v = f(V(), F.col("w"), to)
        return Tensor(joined.select(*keys, (v if types.is_complex(to) else v.cast(types.SQL[to])).alias("v")), shape, to, None, self.sparse and other.sparse, min(self.rows, other.rows))

    def __add__(self, x) -> Tensor:
        return self._merge(x, 1)

    def __sub__(self, x) -> Tensor:
        return self._merge(x, -1)

    def __radd__(self, x) -> Tensor:
        return self._other(x)._merge(self, 1)

    def __rsub__(self, x) -> Tensor:
        return self._other(x)._merge(self, -1)

    def __mul__(self, x) -> Tensor:
        if not isinstance(x, Tensor):
            to = self._other(x).dtype
            return self._with(self.df.select(*self.keys, types.multiply(types.cast(V(), self.dtype, to), types.literal(x, to), to).alias("v")), dtype=to)._typed(to)
        return self._meet(x, types.multiply)

    __rmul__ = __mul__

    def __truediv__(self, x) -> Tensor:
        """a * (1/b) at stored places of b; a dense b is filled in, so dividing by its zeros gives IEEE infinities."""
        other = self._other(x)
        other = other if other.sparse else other.densify()
        mine = self if self.sparse and other.sparse else self.densify()
        to = types.true_divide(self.dtype, other.dtype)
        quotient = (lambda a, b, d: types.multiply(a, types.reciprocal(b, d), d)) if types.is_complex(to) else (lambda a, b, d: types.ieee_divide(a.cast("double"), b.cast("double")))
        return mine._meet(other, quotient, lambda *_: to)

    def __rtruediv__(self, x) -> Tensor:
        return self._other(x) / self

    def __pow__(self, x) -> Tensor:
        other = self._other(x)
        mine = self.densify() if not (self.sparse and other.sparse) else self
        raised = (lambda a, b, d: types.cast(F.pow(a.cast("double"), b.cast("double")), "float64", d))
        return mine._meet(other.densify() if not other.sparse else other, raised)

    def _in_place(self, out: Tensor) -> Tensor:
        if out.dtype != self.dtype or out.shape != self.shape:
            raise TypeError(f"can't put {out.dtype}{out.shape} into {self.dtype}{self.shape}")
        return out

    def __iadd__(self, x) -> Tensor:
        return self._in_place(self + x)

    def __isub__(self, x) -> Tensor:
        return self._in_place(self - x)

    def __imul__(self, x) -> Tensor:
        return self._in_place(self * x)

    def __itruediv__(self, x) -> Tensor:
        return self._in_place(self / x)

    def _filled_join(self, x, what: str) -> tuple[DataFrame, str]:
        a, b, shape, to, other = self._pair(x)
        keys = [f"i{k}" for k in range(len(shape))]
        a, b = a.withColumnRenamed("v", "a"), b.withColumnRenamed("v", "b")
        zero = types.literal(0, to)
        if not keys:
            joined = a.crossJoin(b)
        elif what == "both":
            joined = a.join(b, keys, "full_outer")
        else:
            joined = grid(self.spark, shape).join(a, keys, "left").join(b, keys, "left")
        return joined.select(*keys, F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")), to

    def _compare(self, x, f: Callable[[Column, Column], Column], same: bool) -> Tensor:
        """Booleans; where neither has an entry two zeros are compared, which needs all places if that is true."""
        shape = np.broadcast_shapes(self.shape, self._other(x).shape)
        joined, _ = self._filled_join(x, "grid" if same else "both")
        keys = [f"i{k}" for k in range(len(shape))]
        return Tensor(joined.select(*keys, f(F.col("a"), F.col("b")).alias("v")), shape, "bool", None, not same)

    def __lt__(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a < b, False)

    def __gt__(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a > b, False)

    def __le__(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a <= b, True)

    def __ge__(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a >= b, True)

    def equal(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a == b, True)

    def differs(self, x) -> Tensor:
        return self._compare(x, lambda a, b: a != b, False)

    # Reductions

    def _reduce(self, axis, aggregate: Callable[[Column], Column], dtype: str, keepdims: bool = False, implicit: Callable[[Column, Column, int], Column] | None = None) -> Tensor:
        """aggregate over some modes (None: all). implicit: the result from (aggregate, rows seen, places) where places without a row count too."""
        axes = set(range(self.ndim)) if axis is None else {k % self.ndim for k in ((axis,) if isinstance(axis, int) else axis)}
        rest = [k for k in range(self.ndim) if k not in axes]
        places = prod(self.shape[k] for k in axes)
        grouped = self.df.groupBy(*(f"i{k}" for k in rest)).agg(aggregate(V()).alias("v"), F.count(F.lit(1)).alias("n"))
        v = implicit(V(), F.col("n"), places) if implicit else V()
        shape = tuple(self.shape[k] for k in rest)
        df = grouped.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(rest)), v.alias("v")).where("v is not null")
        out = Tensor(df, shape, dtype, None, self.sparse, min(self.rows, prod(shape)))._typed(dtype)
        if keepdims:
            kept = tuple(1 if k in axes else n for k, n in enumerate(self.shape))
            at = {k: F.col(f"i{j}") for j, k in enumerate(rest)}
            out = out._with(out.df.select(*(at.get(k, F.lit(0).cast("bigint")).alias(f"k{k}") for k in range(self.ndim)), "v").toDF(*self.keys, "v"), kept)
        return out

    def sum(self, axis=None, dtype: str | None = None, keepdims: bool = False) -> Tensor:
        to = dtype or ("int64" if self.dtype == "bool" or self.dtype.startswith("int") else self.dtype)
        return self._reduce(axis, lambda v: types.total(types.cast(v, self.dtype, to), to), to, keepdims)

    def max(self, axis=None, keepdims: bool = False) -> Tensor:
        return self._reduce(axis, F.max, self.dtype, keepdims, lambda v, n, size: F.when(n < size, F.greatest(v, types.literal(0, self.dtype))).otherwise(v))

    def min(self, axis=None, keepdims: bool = False) -> Tensor:
        return self._reduce(axis, F.min, self.dtype, keepdims, lambda v, n, size: F.when(n < size, F.least(v, types.literal(0, self.dtype))).otherwise(v))

    def any(self, axis=None, keepdims: bool = False) -> Tensor:
        return self._reduce(axis, lambda v: F.bool_or(~types.is_zero(v, self.dtype)), "bool", keepdims)

    def all(self, axis=None, keepdims: bool = False) -> Tensor:
        return self._reduce(axis, lambda v: F.bool_and(~types.is_zero(v, self.dtype)), "bool", keepdims, lambda v, n, size: v & (n == size))

    def _scalar(self, value: Column):
        x = self.df.agg(value.alias("x")).first()["x"]
        return 0 if x is None else x

    def figures(self, *names: str) -> DataFrame:
        """One row of several reductions of all values, from one pass: sum, norm1, norm2, sumsq, max, min, norm_inf, nnz. Places without a row count as zeros in max and min only if the tensor is dense."""
        size, zero = types.absolute(V(), self.dtype), ~types.is_zero(V(), self.dtype)
        x = self.densify() if not self.sparse and {"max", "min"} & set(names) else self
        square = F.pow(size.cast("double"), F.lit(2.0))
        known = {"norm1": F.sum(size), "norm2": F.sqrt(F.sum(square)), "sumsq": F.sum(square), "norm_inf": F.max(size), "nnz": F.count(F.when(zero, 1))}
        if not types.is_complex(self.dtype):
            known |= {"sum": F.sum("v"), "max": F.max("v"), "min": F.min("v")}
        return x.df.agg(*(known[n].alias(n) for n in names))

    def norm1(self) -> float:
        return float(self._scalar(F.sum(types.absolute(V(), self.dtype))))

    def norm2(self) -> float:
        return float(self._scalar(F.sqrt(F.sum(F.pow(types.absolute(V(), self.dtype).cast("double"), F.lit(2.0))))))

    def sumsq(self) -> float:
        return float(self._scalar(F.sum(F.pow(types.absolute(V(), self.dtype).cast("double"), F.lit(2.0)))))

    def norm_inf(self) -> float:
        return float(self._scalar(F.max(types.absolute(V(), self.dtype))))

    def min_abs(self) -> float:
        row = self.df.agg(F.min(types.absolute(V(), self.dtype)).alias("x"), F.count(F.lit(1)).alias("n")).first()
        return float(row["x"]) if row["n"] == self.size else 0.0

    def vecnorm(self, ord=2) -> float:
        return {1: self.norm1, 2: self.norm2, np.inf: self.norm_inf}[ord]()

    def norm(self, ord="fro") -> float:
        """Of a matrix: 'fro', 1 (largest column sum), inf (largest row sum), 2 (largest singular value); else of all values as a vector."""
        if self.ndim != 2:
            return self.vecnorm(2 if ord == "fro" else ord)
        if ord == "fro":
            return self.norm2()
        if ord in (1, np.inf):
            return float(abs(self).sum(axis=0 if ord == 1 else 1).norm_inf())
        from . import linalg

        return float(linalg.svd(self, rank=1)[1][0])

    def largest(self, n: int) -> list:
        """The n values of largest magnitude."""
        return [r["v"] for r in self.df.orderBy(types.absolute(V(), self.dtype).desc(), *self.keys).limit(n).collect()]

    def trace(self, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Tensor:
        return self.diagonal(offset, axis1, axis2).sum(axis=-1)

    # Structure

    def densify(self) -> Tensor:
        """Every place has a row."""
        zero = types.literal(0 if self.algebra.zero is None else self.algebra.zero, self.dtype)
        if not self.ndim:
            seen = self.df.agg(F.max("v").alias("v"))
            return self._with(seen.select(F.coalesce("v", zero).alias("v")), sparse=False)
        df = grid(self.spark, self.shape).join(self.df, self.keys, "left").select(*self.keys, F.coalesce("v", zero).alias("v"))
        return self._with(df, sparse=False, rows=self.size)

    def sparsify(self, threshold: float | None = None, take_abs: bool = True, keep: Callable[[Column], Column] | None = None) -> Tensor:
        """Entries above a threshold (None: other than zero), or those that a predicate keeps."""
        if keep is None:
            size = types.absolute(V(), self.dtype) if take_abs else V()
            rows = self.df.where(~types.is_zero(V(), self.dtype)) if threshold is None else self.df.where(size > threshold)
        else:
            rows = self.df.where(keep(V()))
        return self._with(rows, sparse=True)

    def sample(self, p: float, seed: int = 0) -> Tensor:
        """Each entry stays with probability p, by seed and place."""
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *self.keys), 11).cast("double") / F.lit(float(1 << 53))
        return self._with(self.df.where(unit < p), sparse=True, rows=self.rows * p)

    def transpose(self, axes: Sequence[int] | None = None) -> Tensor:
        axes = [k % self.ndim for k in axes] if axes is not None else list(range(self.ndim))[::-1]
        if sorted(axes) != list(range(self.ndim)):
            raise ValueError("axes don't match the tensor")
        return self._with(self.df.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(axes)), "v"), [self.shape[k] for k in axes])

    @property
    def T(self) -> Tensor:
        return self.transpose()

    def reshape(self, *shape) -> Tensor:
        shape = tuple(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else shape
        if -1 in shape:
            known = prod(n for n in shape if n != -1)
            shape = tuple(self.size // known if n == -1 else n for n in shape)
        if prod(shape) != self.size:
            raise ValueError(f"can't reshape {self.shape} to {shape}")
        return self._with(_unravel(self.df.select(self.linear().alias("at"), "v"), shape), shape)

    def ravel(self) -> Tensor:
        return self.reshape(-1)

    def _parts(self, key) -> list:
        key = key if isinstance(key, tuple) else (key,)
        if key.count(Ellipsis) > 1 if all(isinstance(k, (int, slice, type(Ellipsis))) for k in key) else True:
            raise ValueError("an index is of integers, slices and at most one ellipsis")
        if Ellipsis in key:
            at = key.index(Ellipsis)
            key = (*key[:at], *[slice(None)] * (self.ndim - len(key) + 1), *key[at + 1 :])
        key = (*key, *[slice(None)] * (self.ndim - len(key)))
        if len(key) != self.ndim:
            raise IndexError("too many indices")
        out = []
        for k, n in zip(key, self.shape):
            if isinstance(k, int):
                if not -n <= k < n:
                    raise IndexError(f"index {k} of {n}")
                out.append(k % n)
            else:
                out.append(range(*k.indices(n)))
        return out

    @staticmethod
    def _within(at: Column, r: range) -> Column:
        if not len(r):
            return F.lit(False)
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        inside = at.between(low, high)
        return inside if abs(r.step) == 1 else inside & (F.pmod(at - F.lit(r.start), F.lit(abs(r.step))) == 0)

    def __getitem__(self, key) -> Tensor:
        if isinstance(key, str):
            return self.i(key)
        parts = self._parts(key)
        df, names, shape = self.df, [], []
        for k, p in enumerate(parts):
            at = F.col(f"i{k}")
            if isinstance(p, int):
                df = df.where(at == p)
            else:
                df = df.where(self._within(at, p))
                names.append(((at - F.lit(p.start)) / F.lit(p.step)).cast("bigint"))
                shape.append(len(p))
        return self._with(df.select(*(c.alias(f"i{j}") for j, c in enumerate(names)), "v"), shape)

    def assign(self, key, value) -> Tensor:
        """This tensor with a region replaced by a scalar or a tensor broadcast to it."""
        parts = self._parts(key)
        shape = tuple(len(p) for p in parts if not isinstance(p, int))
        inside = F.lit(True)
        for k, p in enumerate(parts):
            at = F.col(f"i{k}")
            inside = inside & (at == p if isinstance(p, int) else self._within(at, p))
        value = value if isinstance(value, Tensor) else Tensor.full(self.spark, (), value, self.dtype)
        rows, j, names = value.astype(self.dtype)._broadcast(shape), 0, []
        for k, p in enumerate(parts):
            if isinstance(p, int):
                names.append(F.lit(p).cast("bigint").alias(f"k{k}"))
            else:
                names.append((F.lit(p.start) + F.col(f"i{j}") * F.lit(p.step)).cast("bigint").alias(f"k{k}"))
                j += 1
        return self._with(self.df.where(~inside).unionByName(rows.select(*names, "v").toDF(*self.keys, "v")))

    def slice(self, offsets: Sequence[int] | int, ends: Sequence[int] | int) -> Tensor:
        """The box from offsets to ends, which it leaves out; two numbers are the row-major places of its first and last corner, both within."""
        if isinstance(offsets, int):
            first, last = (np.unravel_index(x, self.shape) for x in (offsets, ends))
            offsets, ends = [int(x) for x in first], [int(x) + 1 for x in last]
        return self[tuple(slice(a, b) for a, b in zip(offsets, ends))]

    def batches(self) -> list[Tensor]:
        """The slices along the last mode."""
        return [self[(..., k)] for k in range(self.shape[-1])]

    @classmethod
    def from_batches(cls, parts: Sequence[Tensor]) -> Tensor:
        """Slices along a new last mode; the inverse of batches()."""
        return stack([t.reshape(*t.shape, 1) for t in parts], parts[0].ndim)

    def add_from(self, other: Tensor, alpha=1.0, beta=1.0) -> Tensor:
        """beta times this tensor plus alpha times another of the same shape; both are of one session, as all tensors are."""
        return self * beta + other * alpha

    def add_slice(self, offsets: Sequence[int], ends: Sequence[int], other: Tensor, beta=1.0, alpha=1.0) -> Tensor:
        """beta times the box of this tensor plus alpha times other."""
        region = tuple(slice(a, b) for a, b in zip(offsets, ends))
        return self.assign(region, self[region] * beta + other * alpha)

    def take(self, indices: Sequence[int], axis: int | None = None) -> Tensor:
        if axis is None:
            return self.ravel().take(indices, 0)
        axis %= self.ndim
        n = self.shape[axis]
        if any(not -n <= i < n for i in indices):
            raise IndexError("index out of range")
        places: dict[int, list[int]] = {}
        for k, i in enumerate(indices):
            places.setdefault(i % n, []).append(k)
        rows = [(i, k) for i, ks in places.items() for k in ks]
        table = self.spark.createDataFrame(rows, f"i{axis} bigint, place bigint")
        # The index list came from the driver; its size is known.
        joined = self.df.join(F.broadcast(table) if len(rows) < 100_000 else table, f"i{axis}")
        names = [F.col("place" if k == axis else f"i{k}").alias(f"k{k}") for k in range(self.ndim)]
        shape = [len(indices) if k == axis else m for k, m in enumerate(self.shape)]
        return self._with(joined.select(*names, "v").toDF(*self.keys, "v"), shape)

    def permute(self, maps: Sequence[Sequence[int] | None], gather: bool = False, shape: Sequence[int] | None = None) -> Tensor:
        """Scatter: index i of mode k goes to maps[k][i], or away for -1. gather: the result's index i comes from maps[k][i]."""
        df = self.df
        for k, m in enumerate(maps):
            if m is None:
                continue
            rows = [(int(j), i) if gather else (i, int(j)) for i, j in enumerate(m) if j >= 0]
            table = self.spark.createDataFrame(rows, f"i{k} bigint, to bigint")
            df = df.join(F.broadcast(table) if len(rows) < 100_000 else table, f"i{k}").drop(f"i{k}").withColumnRenamed("to", f"i{k}")
        new = shape or [len(m) if m is not None and gather else n for m, n in zip(maps, self.shape)]
        return self._with(df.select(*self.keys, "v"), new)

    def diagonal(self, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Tensor:
        """Entries with i_axis2 - i_axis1 = offset; the diagonal's mode comes last."""
        a, b = F.col(f"i{axis1 % self.ndim}"), F.col(f"i{axis2 % self.ndim}")
        axis1, axis2 = axis1 % self.ndim, axis2 % self.ndim
        rest = [k for k in range(self.ndim) if k not in (axis1, axis2)]
        length = max(0, min(self.shape[axis1] - max(-offset, 0), self.shape[axis2] - max(offset, 0)))
        rows = self.df.where(b - a == offset).select(*(F.col(f"i{k}").alias(f"k{j}") for j, k in enumerate(rest)), F.least(a, b).alias("at"), "v")
        shape = [*(self.shape[k] for k in rest), length]
        return self._with(rows.toDF(*(f"i{j}" for j in range(len(shape))), "v"), shape)

    def diag(self, k: int = 0) -> Tensor:
        if self.ndim == 1:
            n = self.shape[0] + abs(k)
            return self._with(self.df.select((F.col("i0") + max(-k, 0)).alias("i0"), (F.col("i0") + max(k, 0)).alias("i1"), "v"), (n, n))
        return self.diagonal(k)

    def tril(self, k: int = 0) -> Tensor:
        return self._with(self.df.where(F.col("i1") - F.col("i0") <= k))

    def triu(self, k: int = 0) -> Tensor:
        return self._with(self.df.where(F.col("i1") - F.col("i0") >= k))

    def prefix_sum(self, exclusive: bool = True) -> Tensor:
        """Sums of a vector's values before each index. Blocks of indices are summed first, so that no window has all rows."""
        if self.ndim != 1:
            raise ValueError("prefix sums are of vectors")
        from .scans import prefix

        return prefix(self, exclusive)

    # Points

    def _points(self, coordinates, values=None) -> Tensor:
        if isinstance(coordinates, DataFrame):
            return Tensor(coordinates, self.shape, self.dtype, self.algebra)
        rows = []
        for n, c in enumerate(coordinates):
            at = np.unravel_index(c, self.shape) if isinstance(c, (int, np.integer)) else c
            rows.append((*(int(x) for x in at), None if values is None else np.asarray(values[n]).astype(self.dtype).item()))
        return Tensor(self.spark.createDataFrame(rows, schema(self.ndim, self.dtype)), self.shape, self.dtype, self.algebra)

    def write(self, coordinates, values=None, alpha=1, beta=0) -> Tensor:
        """beta * A + alpha * value at some places (linear row-major or coordinates, or a DataFrame i0.., v); values of a place given twice are summed first."""
        new = self._points(coordinates, values)
        new = new.df.groupBy(*self.keys).agg(self.algebra.plus(V()).alias("v"))
        if not types.is_complex(self.dtype):
            new = new.withColumn("v", (V() * alpha).cast(types.SQL[self.dtype]) if self.dtype != "bool" else V())
        if not beta:
            return self._with(self.df.join(new, self.keys, "left_anti").unionByName(new))
        old = self.df.join(new.select(*self.keys), self.keys, "left_semi")
        both = old.withColumn("v", (V() * beta).cast(types.SQL[self.dtype])).unionByName(new).groupBy(*self.keys).agg(self.algebra.plus(V()).alias("v"))
        return self._with(self.df.join(new, self.keys, "left_anti").unionByName(both))

    def read(self, coordinates, values=None, alpha=1, beta=0) -> DataFrame:
        """Each place asked for and its value, zero where there is no entry; with values, beta * value + alpha * A where there is one."""
        asked = self._points(coordinates, values).df.withColumnRenamed("v", "given")
        zero = types.literal(0 if self.algebra.zero is None else self.algebra.zero, self.dtype)
        joined = asked.join(self.df, self.keys, "left")
        if values is None or not beta:
            v = F.coalesce(V() if alpha == 1 else V() * alpha, zero)
        else:
            v = F.when(V().isNull(), zero).otherwise(F.col("given") * beta + V() * alpha)
        return joined.select(*self.keys, v.alias("v"))


def _uniform(n: int, low: float, high: float, seed: int, dtype: str) -> Column:
    """A value in [low, high) that follows from seed and place."""
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *(f"i{k}" for k in range(n))), 11).cast("double") / F.lit(float(1 << 53))
    value = lambda salt: unit(salt) * (high - low) + low
    if types.is_complex(dtype):
        return F.struct(value(2).alias("re"), value(3).alias("im"))
    return (F.floor(value(2)) if dtype.startswith("int") else value(2)).cast(types.SQL[dtype])


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All places of a shape, from one distributed range."""
    return _unravel(spark.range(prod(shape)).select(F.col("id").alias("at"), F.lit(None).alias("v")), shape).drop("v")


def _unravel(df: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(at, v) with a row-major place to (i0.., v)."""
    names = []
    for k, n in enumerate(shape):
        below = prod(shape[k + 1 :])
        at = F.expr(f"at div {below}") if below > 1 else F.col("at")
        names.append((F.pmod(at, F.lit(n)) if k and n else at).cast("bigint").alias(f"i{k}"))
    return df.select(*names, "v")


def einsum(notation: str, *operands: Tensor, algebra: Algebra | None = None, times=None, distributive: bool | None = None, out: Tensor | None = None, out_scale=0, sizes: dict[str, int] | None = None) -> Tensor:
    """Contract operands as subscripts say. out and out_scale: add out_scale times an existing tensor."""
    inputs, output = subscripts.parse(notation, len(operands))
    lengths = subscripts.sizes(inputs, [t.shape for t in operands], sizes)
    if missing := [c for c in output if c not in lengths]:
        raise ValueError(f"output labels without a length: {missing}")
    dtype = types.promote(*(t.dtype for t in operands))
    algebra = algebra or (operands[0].algebra if len({t.algebra.name for t in operands}) == 1 else ring(dtype))
    leaves = []
    for t, labels in zip(operands, inputs):
        known = t.statistics
        if algebra.name.startswith("ring") and t.dtype != dtype:
            t = t.astype(dtype)
            t.statistics = known
        leaves.append(t.leaf(labels))
    df = planner.contract(leaves, output, lengths, algebra, times, distributive)
    shape = tuple(lengths[c] for c in output)
    result = Tensor(df, shape, dtype, algebra, all(t.sparse for t in operands if t.ndim), prod(shape))
    if algebra.name.startswith("ring") and not types.is_complex(dtype):
        result = result._with(result.df.withColumn("v", V().cast(types.SQL[dtype])))
        result.algebra = algebra
    if out is not None and out_scale:
        result = out * out_scale + result
    return result


def dot(a: Tensor, b: Tensor) -> Tensor:
    """Last mode of a with the first of b; a scalar multiplies."""
    return tensordot(a, b, 1) if a.ndim and b.ndim else a * b


def tensordot(a: Tensor, b: Tensor, axes=2) -> Tensor:
    if isinstance(axes, int):
        axes = (list(range(a.ndim - axes, a.ndim)), list(range(axes)))
    left, right = ([x] if isinstance(x, int) else list(x) for x in axes)
    names = _letters(a.ndim + b.ndim)
    la, lb = list(names[: a.ndim]), list(names[a.ndim :])
    for x, y in zip(left, right):
        lb[y % b.ndim] = la[x % a.ndim]
    summed = {la[x % a.ndim] for x in left}
    out = [c for c in la if c not in summed] + [c for c in lb if c not in summed]
    return einsum(f"{''.join(la)},{''.join(lb)}->{''.join(out)}", a, b)


def kron(a: Tensor, b: Tensor) -> Tensor:
    n = max(a.ndim, b.ndim)
    a, b = a.reshape((1,) * (n - a.ndim) + a.shape), b.reshape((1,) * (n - b.ndim) + b.shape)
    names = _letters(2 * n)
    out = "".join(x + y for x, y in zip(names[:n], names[n:]))
    return einsum(f"{names[:n]},{names[n:]}->{out}", a, b).reshape(tuple(x * y for x, y in zip(a.shape, b.shape)))


def outer(a: Tensor, b: Tensor) -> Tensor:
    return tensordot(a, b, 0)


def stack(tensors: Sequence[Tensor], axis: int) -> Tensor:
    """Tensors one after the other along a mode."""
    dtype = types.promote(*(t.dtype for t in tensors))
    df, at = None, 0
    for t in tensors:
        part = t.astype(dtype).df.withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(at))
        df = part if df is None else df.unionByName(part)
        at += t.shape[axis]
    shape = [at if k == axis else n for k, n in enumerate(tensors[0].shape)]
    return Tensor(df, shape, dtype, None, all(t.sparse for t in tensors), sum(t.rows for t in tensors))


def vstack(tensors: Sequence[Tensor]) -> Tensor:
    return stack([t.reshape(1, -1) if t.ndim == 1 else t for t in tensors], 0)


def hstack(tensors: Sequence[Tensor]) -> Tensor:
    return stack(tensors, 0 if tensors[0].ndim == 1 else 1)
