"""Tensors of order 0, 1 and 2 under names of their own, and seeds that random tensors take in turn."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .tensor import Tensor


class _Ordered(Tensor):
    order = 0

    def __init__(self, t: Tensor):
        if t.ndim != self.order:
            raise ValueError(f"{type(self).__name__} has {self.order} modes, not {t.ndim}")
        super().__init__(t.stored, t.shape, t.dtype, t.algebra, t.sparse, t.rows, t.sym)


class Scalar(_Ordered):
    order = 0

    @classmethod
    def of(cls, spark: SparkSession, value, dtype: str = "float64") -> Scalar:
        return cls(Tensor.full(spark, (), value, dtype))

    def get(self):
        return self.item()

    def set(self, value) -> Scalar:
        return Scalar(Tensor.full(self.spark, (), value, self.dtype))


class Vector(_Ordered):
    order = 1

    @property
    def length(self) -> int:
        return self.shape[0]


class Matrix(_Ordered):
    order = 2

    @property
    def rows_columns(self) -> tuple[int, int]:
        return self.shape[0], self.shape[1]


class Seeds:
    """Seeds for random tensors: each that is asked for differs from those before, and all follow from the first."""

    def __init__(self, first: int = 0):
        self.first, self.given = first, 0

    def next(self) -> int:
        self.given += 1
        return self.first * 1_000_003 + self.given
