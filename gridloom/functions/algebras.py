"""Algebraic structures: what adds up rows that meet, what joins two values, and their identities.

An algebra without `times` is a monoid, without `plus` a mere set, with `minus` a group or ring. `distributive` tells
the planner that sums may be taken before a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import types


@dataclass(frozen=True)
class Algebra:
    name: str
    plus: Callable[[Column], Column] | None = None
    times: Callable[[Column, Column], Column] | None = None
    zero: object = None
    one: object = None
    minus: Callable[[Column], Column] | None = None
    distributive: bool = True
    #: Least and greatest are their own sums: adding a value twice changes nothing.
    idempotent: bool = False
    #: If not, operands are multiplied in the order in which they are given.
    commutative: bool = True
    #: In place of plus, for elements that no aggregate column adds up: (rows with keys and v, keys) to rows of different keys.
    summed: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None


def ring(dtype: str) -> Algebra:
    """The default of an element type: sum and product; or and and for booleans."""
    if dtype == "bool":
        return BOOLEAN
    return Algebra(f"ring-{dtype}", lambda v: types.total(v, dtype), lambda a, b: types.multiply(a, b, dtype), 0, 1, lambda v: types.negative(v, dtype))


BOOLEAN = Algebra("boolean", F.bool_or, lambda a, b: a & b, False, True, idempotent=True)
MIN_PLUS = Algebra("min-plus", F.min, lambda a, b: a + b, float("inf"), 0, idempotent=True)
MAX_PLUS = Algebra("max-plus", F.max, lambda a, b: a + b, float("-inf"), 0, idempotent=True)
MAX_TIMES = Algebra("max-times", F.max, lambda a, b: a * b, 0, 1, idempotent=True)
MIN_TIMES = Algebra("min-times", F.min, lambda a, b: a * b, float("inf"), 1, idempotent=True)
#: Shortest paths with their hops: least (w, h) in order, both added along a path.
HOPS = Algebra("hops", F.min, lambda a, b: F.struct((a["w"] + b["w"]).alias("w"), (a["h"] + b["h"]).alias("h")), None, None, idempotent=True)
#: Pairs summed component by component.
PAIRS = Algebra("pairs", lambda v: F.struct(F.sum(v["a"]).alias("a"), F.sum(v["b"]).alias("b")), lambda a, b: F.struct((a["a"] * b["a"]).alias("a"), (a["b"] * b["b"]).alias("b")), None, None)


def monoid(name: str, plus: Callable[[Column], Column], zero=None) -> Algebra:
    return Algebra(name, plus, None, zero)


def multiplicity(rows, *key: str):
    """Shortest paths and how many there are: of rows (key, w, m) the least w of each key and the sum of m where w is least. Aggregated twice, so both passes combine before the shuffle."""
    sums = rows.groupBy(*key, "w").agg(F.sum("m").alias("m"))
    return sums.groupBy(*key).agg(F.min(F.struct("w", "m")).alias("x")).select(*key, "x.w", "x.m")
