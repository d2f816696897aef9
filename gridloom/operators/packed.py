"""Tensors with symmetries over several groups of modes, stored once and contracted as stored.

A chain such as SY SY NS says how each mode goes with the next one: runs of one kind are a group of modes. Of the entries that a group's
symmetry makes equal (SY, SH) or equal up to sign (AS) one is stored, that of ascending indices; AS and SH have no equal ones.

A contraction looks at what becomes of a group's labels. Labels that stay in the result stay a group of it. Labels that
are summed with a group of the other operand are matched in ascending order on both sides, and each match counts as often as its
indices have orders. Labels summed with modes that have no symmetry are matched after that operand's entries have been brought to ascending order, with
their sign, and added up. A group that is wholly of one such sort isn't expanded at all; else its entries are dealt over the sorts, as many ways as
there are choices of indices for each, which is fewer than the orders that the group stands for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..functions.algebras import ring
from ..plans import subscripts
from .tensor import V, Tensor

KINDS = ("NS", "SY", "AS", "SH")


@dataclass(frozen=True)
class Group:
    """Modes that may change places: SY keeping the value, AS changing its sign, SH as SY without equal indices."""

    kind: str
    modes: tuple[int, ...]


def groups_of(chain: Sequence[str]) -> list[Group]:
    """Groups of a chain: the k-th kind says how mode k goes with mode k + 1; the last one is NS."""
    if any(k not in KINDS for k in chain) or chain and chain[-1] != "NS":
        raise ValueError(f"a chain has kinds of {KINDS} and ends with NS")
    out, run = [], [0]
    for k, kind in enumerate(chain):
        if kind == "NS":
            if len(run) > 1:
                out.append(Group(chain[k - 1], tuple(run)))
            run = [k + 1]
        else:
            if len(run) > 1 and chain[k - 1] != kind:
                raise ValueError("the modes of a group have one kind of symmetry")
            run.append(k + 1)
    return out


def _parity(p: Sequence[int]) -> int:
    return -1 if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else 1


def _ascending(at: Sequence[Column], kind: str) -> Column:
    out = F.lit(True)
    for a, b in zip(at, at[1:]):
        out = out & (a <= b if kind == "SY" else a < b)
    return out


def orders(at: Sequence[Column]) -> Column:
    """In how many orders ascending indices can be put: the factorial of their number over those of runs of equal ones."""
    out, run = F.lit(factorial(len(at))), F.lit(1)
    for a, b in zip(at, at[1:]):
        run = F.when(a == b, run + 1).otherwise(1)
        out = out / run
    return F.round(out).cast("double")


class Packed:
    def __init__(self, df: DataFrame, shape: Sequence[int], groups: Sequence[Group], dtype: str = "float64"):
        """df: i0 .., v with ascending indices in each group, a row at most for each place."""
        self.df, self.shape, self.groups, self.dtype = df, tuple(shape), list(groups), dtype
        for g in self.groups:
            if len({self.shape[m] for m in g.modes}) > 1:
                raise ValueError(f"modes of a group are of one length, not {[self.shape[m] for m in g.modes]}")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def keys(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @classmethod
    def pack(cls, t: Tensor, chain: Sequence[str] | Sequence[Group]) -> Packed:
        """The stored entries of a tensor that has the symmetry already."""
        groups = chain if chain and isinstance(chain[0], Group) else groups_of(chain)
        df = t.df
        for g in groups:
            df = df.where(_ascending([F.col(f"i{m}") for m in g.modes], g.kind))
        return cls(df, t.shape, groups, t.dtype)

    @classmethod
    def aligned(cls, t: Tensor, chain: Sequence[str] | Sequence[Group]) -> Packed:
        """Entries in any order brought to ascending indices, with their sign, and added up: the sum of a tensor over the orders of each group."""
        groups = chain if chain and isinstance(chain[0], Group) else groups_of(chain)
        df = t.df
        for g in groups:
            df = _sorted(df, [f"i{m}" for m in g.modes], g.kind, t.dtype)
        df = df.groupBy(*t.keys).agg(ring(t.dtype).plus(V()).alias("v"))
        return cls(df, t.shape, groups, t.dtype)

    @classmethod
    def of(cls, t: Tensor) -> Packed:
        """A tensor, with the pair of modes that it has stored once, if any."""
        if t.sym is None:
            return cls(t.df, t.shape, [], t.dtype)
        kind, a, b = t.sym
        return cls(t.stored, t.shape, [Group(kind, (a, b))], t.dtype)

    def unpacked(self) -> Tensor:
        """All entries that the stored ones stand for."""
        df = self.df
        for g in self.groups:
            df = _dealt(df, [f"i{m}" for m in g.modes], [[k] for k in range(len(g.modes))], g.kind, self.dtype)
        return Tensor(df.select(*self.keys, "v"), self.shape, self.dtype)

    def stored_size(self) -> int:
        """How many places are stored."""
        n, grouped = 1, {m for g in self.groups for m in g.modes}
        for k, m in enumerate(self.shape):
            n *= 1 if k in grouped else m
        for g in self.groups:
            m, r = self.shape[g.modes[0]], len(g.modes)
            top = m + r - 1 if g.kind == "SY" else m
            ways = 1
            for j in range(r):
                ways = ways * (top - j) // (j + 1)
            n *= max(ways, 0)
        return n

    def _weight(self) -> Column:
        out = F.lit(1.0)
        for g in self.groups:
            out = out * orders([F.col(f"i{m}") for m in g.modes])
        return out

    def norm2(self) -> float:
        """The 2-norm of all entries, from the stored ones."""
        total = self.df.agg(F.sqrt(F.sum(self._weight() * F.pow(types.absolute(V(), self.dtype).cast("double"), F.lit(2.0)))).alias("x")).first()["x"]
        return total or 0.0

    def __mul__(self, s) -> Packed:
        return Packed(self.df.withColumn("v", types.multiply(V(), types.literal(s, self.dtype), self.dtype)), self.shape, self.groups, self.dtype)

    __rmul__ = __mul__

    def __add__(self, other: Packed) -> Packed:
        """Of two tensors with the same groups."""
        if self.shape != other.shape or sorted(self.groups, key=repr) != sorted(other.groups, key=repr):
            raise ValueError("only tensors of one shape and symmetry are added as stored")
        to = types.promote(self.dtype, other.dtype)
        both = self.df.withColumn("v", types.cast(V(), self.dtype, to)).unionByName(other.df.withColumn("v", types.cast(V(), other.dtype, to)))
        return Packed(both.groupBy(*self.keys).agg(ring(to).plus(V()).alias("v")), self.shape, self.groups, to)


def _sorted(df: DataFrame, names: list[str], kind: str, dtype: str) -> DataFrame:
    """Columns of indices in ascending order in each row, v with the sign of that order for AS; rows with equal indices go where the kind has none."""
    at = [F.col(c) for c in names]
    if kind != "SY":
        for a, b in combinations(at, 2):
            df = df.where(a != b)
    v = V()
    if kind == "AS":
        inversions = F.lit(0)
        for a, b in combinations(at, 2):
            inversions = inversions + (a > b).cast("int")
        v = F.when(inversions % 2 == 1, types.negative(V(), dtype)).otherwise(V())
    ordered = F.array_sort(F.array(*at))
    rest = [F.col(c) for c in df.columns if c not in names and c != "v"]
    return df.select(*rest, *(ordered[k].alias(c) for k, c in enumerate(names)), v.alias("v"))


def _dealt(df: DataFrame, names: list[str], parts: list[list[int]], kind: str, dtype: str) -> DataFrame:
    """Rows with ascending indices in some columns, dealt over parts of these columns in every way that gives other rows; within a part indices ascend."""
    if len(parts) == 1:
        return df
    at = [F.col(c) for c in names]
    ways = []
    for p in permutations(range(len(names))):
        if all(p[a] < p[b] for part in parts for a, b in zip(part, part[1:])):
            value = types.negative(V(), dtype) if kind == "AS" and _parity(p) < 0 else V()
            ways.append(F.struct(*(at[p[k]].alias(c) for k, c in enumerate(names)), value.alias("v")))
    rest = [F.col(c) for c in df.columns if c not in names and c != "v"]
    every = F.array(*ways)
    # Equal indices give one row in several ways.
    return df.select(*rest, F.explode(F.array_distinct(every) if kind == "SY" else every).alias("way")).select(*(c for c in df.columns if c not in names and c != "v"), "way.*")


def _alike(a: str, b: str) -> bool:
    return a == b == "AS" or {a, b} <= {"SY", "SH"}


def contract(notation: str, a: Packed | Tensor, b: Packed | Tensor) -> Packed:
    """A contraction of two operands as they are stored; the result keeps the groups that its labels come from. No operand repeats a label."""
    a, b = (x if isinstance(x, Packed) else Packed.of(x) for x in (a, b))
    inputs, out = subscripts.parse(notation, 2)
    la, lb = inputs
    if any(len(set(s)) != len(s) for s in (la, lb, out)):
        raise ValueError("labels of an operand or result are all different")
    size = subscripts.sizes(inputs, [a.shape, b.shape], None)
    if set(out) - set(size):
        raise ValueError(f"output labels without a length: {sorted(set(out) - set(size))}")
    to = types.promote(a.dtype, b.dtype)
    named_a = [(g.kind, [la[m] for m in g.modes]) for g in a.groups]
    named_b = [(g.kind, [lb[m] for m in g.modes]) for g in b.groups]
    sorts: list[tuple[str, tuple[str, ...]]] = []
    counted: list[tuple[str, ...]] = []
    matched: list[tuple[str, tuple[str, ...]]] = []
    aligned: dict[int, list[tuple[str, list[str]]]] = {0: [], 1: []}

    def parted(k: int, kind: str, labels: list[str]) -> list[list[str]]:
        """What becomes of a group's labels of operand k: parts that stay together."""
        others, grouped = (lb, named_b) if k == 0 else (la, named_a)
        left = [c for c in labels if c in out and c not in others]
        alone = [c for c in labels if c not in out and c not in others]
        # Summed by themselves, the orders of antisymmetric indices cancel; those of others count.
        parts = [p for p in (left, *([[c] for c in alone] if kind == "AS" else [alone])) if p]
        if len(left) > 1:
            sorts.append((kind, tuple(left)))
        if len(alone) > 1 and kind != "AS":
            counted.append(tuple(alone))
        shared = [c for c in labels if c not in out and c in others]
        free = [c for c in shared if not any(c in g for _, g in grouped)]
        if free:
            parts.append(free)
            if len(free) > 1:
                aligned[1 - k].append((kind, free))
        for other, g in grouped:
            met = [c for c in shared if c in g]
            if len(met) > 1 and _alike(kind, other):
                parts.append(met)
                if k == 0:
                    counted.append(tuple(met))
                    matched.append((kind, tuple(met)))
            else:
                parts += [[c] for c in met]
        return parts + [[c] for c in labels if c in out and c in others]

    def rows(k: int, x: Packed, own: str, grouped: list[tuple[str, list[str]]]) -> DataFrame:
        df = x.df.select(*(F.col(f"i{m}").alias(_name(c)) for m, c in enumerate(own)), types.cast(V(), x.dtype, to).alias("v"))
        for kind, labels in grouped:
            parts = parted(k, kind, labels)
            df = _dealt(df, [_name(c) for c in labels], [[labels.index(c) for c in p] for p in parts], kind, to)
        return df

    left, right = rows(0, a, la, named_a), rows(1, b, lb, named_b)
    for k, own in ((0, la), (1, lb)):
        for kind, labels in aligned[k]:
            part = _sorted(left if k == 0 else right, [_name(c) for c in labels], kind, to)
            part = part.groupBy(*(_name(c) for c in own)).agg(ring(to).plus(V()).alias("v"))
            left, right = (part, right) if k == 0 else (left, part)
    shared = [c for c in la if c in lb]
    # Matched labels ascend in their own order on each side: the other operand's columns go by this one's order.
    turned: dict[str, str] = {}
    sign = 1
    for kind, labels in matched:
        own = sorted(labels, key=lb.index)
        turned.update({_name(theirs): _name(c) for theirs, c in zip(own, labels)})
        sign *= _parity([own.index(c) for c in labels]) if kind == "AS" else 1
    if turned:
        right = right.select(*(F.col(c).alias(turned.get(c, c)) for c in right.columns))
    right = right.withColumnRenamed("v", "w")
    joined = left.join(right, [_name(c) for c in shared]) if shared else left.crossJoin(right)
    weight = None
    for labels in counted:
        own = orders([F.col(_name(c)) for c in labels])
        weight = own if weight is None else weight * own
    v = types.multiply(V(), F.col("w"), to)
    if weight is not None:
        v = types.multiply(v, types.cast(weight, "float64", to), to)
    keys = [_name(c) for c in out]
    summed = joined.select(*keys, v.alias("v")).groupBy(*keys).agg(ring(to).plus(V()).alias("v"))
    if not keys:
        summed = summed.where("v is not null")
    groups = [Group(kind, tuple(sorted(out.index(c) for c in labels))) for kind, labels in sorts]
    # A group's indices ascend along its own modes; the result wants them along its modes.
    place = {c: c for c in out}
    for _, labels in sorts:
        place.update(dict(zip(sorted(labels, key=out.index), labels)))
    result = summed.select(*(F.col(_name(place[c])).alias(f"i{k}") for k, c in enumerate(out)), "v")
    for kind, labels in sorts:
        sign *= _parity([sorted(labels, key=out.index).index(c) for c in labels]) if kind == "AS" else 1
    if sign < 0:
        result = result.withColumn("v", types.negative(V(), to))
    return Packed(result, [size[c] for c in out], groups, to)


def _name(label: str) -> str:
    # Column names ignore case, labels don't.
    return f"{label}_{ord(label)}"
