"""Elementwise functions of one value: (column, element type) to (column, element type)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types

_EXP = {"int8": "float32", "int16": "float32", "int32": "float64", "int64": "float64", "float32": "float32", "float64": "float64"}


def _float_only(name: str, dtype: str) -> None:
    if dtype not in ("float32", "float64"):
        raise TypeError(f"{name} is defined for float32 and float64, not {dtype}")


def exp(v: Column, dtype: str) -> tuple[Column, str]:
    if types.is_complex(dtype):
        scale = F.exp(v["re"])
        return F.struct((scale * F.cos(v["im"])).alias("re"), (scale * F.sin(v["im"])).alias("im")), dtype
    if dtype not in _EXP:
        raise TypeError(f"exp isn't defined for {dtype}")
    return F.exp(v.cast("double")).cast(types.SQL[_EXP[dtype]]), _EXP[dtype]


def floor(v: Column, dtype: str) -> tuple[Column, str]:
    _float_only("floor", dtype)
    return F.floor(v).cast(types.SQL[dtype]), dtype


def ceil(v: Column, dtype: str) -> tuple[Column, str]:
    _float_only("ceil", dtype)
    return F.ceil(v).cast(types.SQL[dtype]), dtype


def rint(v: Column, dtype: str) -> tuple[Column, str]:
    """Halves go away from zero."""
    _float_only("rint", dtype)
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast(types.SQL[dtype]), dtype


def clip(low: float | None, high: float | None):
    def apply(v: Column, dtype: str) -> tuple[Column, str]:
        _float_only("clip", dtype)
        out = v if low is None else F.greatest(F.lit(low).cast(types.SQL[dtype]), v)
        return out if high is None else F.least(F.lit(high).cast(types.SQL[dtype]), out), dtype

    return apply


def absolute(v: Column, dtype: str) -> tuple[Column, str]:
    return types.absolute(v, dtype).cast(types.SQL[types.real_of(dtype)]), types.real_of(dtype)


def negative(v: Column, dtype: str) -> tuple[Column, str]:
    return types.negative(v, dtype), dtype


def conj(v: Column, dtype: str) -> tuple[Column, str]:
    return types.conjugate(v, dtype), dtype


def real(v: Column, dtype: str) -> tuple[Column, str]:
    return (v["re"].cast(types.SQL[types.real_of(dtype)]) if types.is_complex(dtype) else v), types.real_of(dtype)


def imag(v: Column, dtype: str) -> tuple[Column, str]:
    return (v["im"].cast(types.SQL[types.real_of(dtype)]) if types.is_complex(dtype) else types.literal(0, dtype)), types.real_of(dtype)


#: Functions that map zero to something else: a dense tensor is filled in before they apply.
MOVES_ZERO = {"exp"}
