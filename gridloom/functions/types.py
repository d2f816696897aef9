"""Element types and arithmetic on columns of them. Complex values are structs (re, im) of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SQL = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "float32": "float", "float64": "double", "complex64": "struct<re:double,im:double>", "complex128": "struct<re:double,im:double>",
}


def is_complex(dtype: str) -> bool:
    return dtype.startswith("complex")


def promote(*dtypes: str) -> str:
    out = np.result_type(*(np.dtype(d) for d in dtypes)).name
    return "float32" if out == "float16" else out


def true_divide(a: str, b: str) -> str:
    both = promote(a, b)
    return both if both.startswith(("float", "complex")) else "float64"


def real_of(dtype: str) -> str:
    return {"complex64": "float32", "complex128": "float64"}.get(dtype, dtype)


def literal(value, dtype: str) -> Column:
    if is_complex(dtype):
        value = complex(value)
        return F.struct(F.lit(value.real).alias("re"), F.lit(value.imag).alias("im"))
    if dtype == "bool":
        return F.lit(bool(value))
    return F.lit(float(value) if dtype.startswith("float") else int(value)).cast(SQL[dtype])


def to_complex(v: Column, dtype: str) -> Column:
    return v if is_complex(dtype) else F.struct(v.cast("double").alias("re"), F.lit(0.0).alias("im"))


def cast(v: Column, source: str, target: str) -> Column:
    if source == target or (is_complex(source) and is_complex(target)):
        return v
    if is_complex(target):
        return to_complex(v, source)
    if is_complex(source):
        v = v["re"]
    if target == "bool":
        return v != 0 if source != "bool" else v
    if source == "bool":
        v = v.cast("int")
    return v.cast(SQL[target])


def add(a: Column, b: Column, dtype: str) -> Column:
    if is_complex(dtype):
        return F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im"))
    return (a | b) if dtype == "bool" else a + b


def negative(a: Column, dtype: str) -> Column:
    if is_complex(dtype):
        return F.struct((-a["re"]).alias("re"), (-a["im"]).alias("im"))
    return -a


def multiply(a: Column, b: Column, dtype: str) -> Column:
    if is_complex(dtype):
        return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))
    return (a & b) if dtype == "bool" else a * b


def reciprocal(a: Column, dtype: str) -> Column:
    """1/a with IEEE results: an infinity for 0."""
    if is_complex(dtype):
        n = a["re"] * a["re"] + a["im"] * a["im"]
        return F.struct(ieee_divide(a["re"], n).alias("re"), ieee_divide(-a["im"], n).alias("im"))
    return ieee_divide(F.lit(1.0), a.cast("double"))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles; division by zero gives an infinity or NaN instead of an error."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))


def absolute(a: Column, dtype: str) -> Column:
    return F.hypot(a["re"], a["im"]) if is_complex(dtype) else F.abs(a)


def conjugate(a: Column, dtype: str) -> Column:
    return F.struct(a["re"].alias("re"), (-a["im"]).alias("im")) if is_complex(dtype) else a


def is_zero(a: Column, dtype: str) -> Column:
    if is_complex(dtype):
        return (a["re"] == 0) & (a["im"] == 0)
    return ~a if dtype == "bool" else a == 0


def total(v: Column, dtype: str) -> Column:
    """Sum of a column; complex parts are summed apart, booleans or-ed."""
    if is_complex(dtype):
        return F.struct(F.coalesce(F.sum(v["re"]), F.lit(0.0)).alias("re"), F.coalesce(F.sum(v["im"]), F.lit(0.0)).alias("im"))
    return F.bool_or(v) if dtype == "bool" else F.sum(v)
