"""The contraction planner: from labelled operands to a plan of joins and grouped sums.

In order: keep the diagonal of operands that repeat a label; sum out labels that only one operand has (if the algebra
distributes, and if that leaves clearly fewer rows: else the label is only dropped, and its rows are summed later); pick the cheapest binary tree, by dynamic programming over subsets of up to EXACT operands and greedily
beyond; join pair by pair on shared labels and sum out what no later operand needs; add labels that only the output
has; repeat columns that the output repeats.

Row counts are estimates: from an operand's statistics if it has been analysed (statistics.py), else its own count or its grid's size. They choose the
order only. Which side of a join is broadcast, how many partitions a shuffle has and how skew is met is left to adaptive
execution, which knows sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebras import Algebra
from .statistics import Shares, Statistics

#: Operands up to which all trees are weighed.
EXACT = 8


@dataclass
class Leaf:
    """A relation with one column for each label, and v. repeats: equal labels may have several rows, still to be summed."""

    df: DataFrame
    labels: tuple[str, ...]
    rows: float
    repeats: bool = False
    #: By label, where known.
    shares: dict[str, Shares] = field(default_factory=dict)


#: A sum before the end is worth its shuffle if it leaves at most this share of the rows.
WORTH = 0.5


def leaf(df: DataFrame, labels: str, rows: float, statistics: Statistics | None = None) -> Leaf:
    """df has columns i0.., v; a repeated label keeps the rows where its columns agree."""
    first: dict[str, int] = {}
    condition = None
    for k, c in enumerate(labels):
        if c in first:
            same = F.col(f"i{first[c]}") == F.col(f"i{k}")
            condition = same if condition is None else condition & same
        else:
            first[c] = k
    kept = df if condition is None else df.where(condition)
    return Leaf(kept.select(*(F.col(f"i{k}").alias(_name(c)) for c, k in first.items()), "v"), tuple(first), statistics.rows if statistics else rows, False, {c: statistics.modes[k] for c, k in first.items()} if statistics else {})


def _name(label: str) -> str:
    # Column names ignore case, labels don't.
    return f"{label}_{ord(label)}"


#: Longest array that repeats a row.
REPEATS = 1 << 16


def repeated(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row once for each of 0 .. n - 1, in a column of this name. Long modes are exploded in two steps, so that no array is long."""
    if not n:
        return df.where("false").withColumn(name, F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    if n <= REPEATS:
        return df.withColumn(name, F.explode(F.sequence(long(0), long(n - 1))))
    block = REPEATS if n <= REPEATS * REPEATS else 1 << (n.bit_length() // 2 + 1)
    df = df.withColumn(name, F.explode(F.sequence(long(0), long((n - 1) // block))))
    return df.withColumn(name, F.explode(F.sequence(F.col(name) * block, F.least(F.col(name) * block + block - 1, long(n - 1)))))


def partitioning(df: DataFrame) -> tuple[list[int], int] | None:
    """Modes by whose hash a relation's rows are partitioned, and the number of partitions; None where they aren't."""
    plan = df._jdf.queryExecution().sparkPlan().outputPartitioning()
    found = re.fullmatch(r"hashpartitioning\((.*), (\d+)\)", plan.toString()) or re.fullmatch(r"HashPartitioning\(\w+\((.*)\),(\d+)\)", plan.toString())
    modes = [re.fullmatch(r"i(\d+)#\d+L?", x.strip()) for x in found.group(1).split(", ")] if found else []
    return ([int(m.group(1)) for m in modes], int(found.group(2))) if modes and all(modes) else None


def summed(x: Leaf, keep: set[str], algebra: Algebra, sizes: dict[str, int], last: bool = True) -> Leaf:
    """x under the labels to keep. Before the last step rows are only summed where that pays."""
    left = tuple(c for c in x.labels if c in keep)
    if left == x.labels and not (x.repeats and last):
        return x
    rows, shares = _kept(x.rows, x.shares, left, sizes)
    keys = [_name(c) for c in left]
    if not last and rows > WORTH * x.rows:
        return Leaf(x.df.select(*keys, "v"), left, x.rows, True, x.shares)
    out = algebra.summed(x.df.select(*keys, "v"), keys) if algebra.summed else x.df.groupBy(*keys).agg(algebra.plus(F.col("v")).alias("v"))
    return Leaf(out if keys else out.where("v is not null"), left, rows, False, shares)


def _kept(rows: float, shares: dict[str, Shares], labels: Iterable[str], sizes: dict[str, int]) -> tuple[float, dict[str, Shares]]:
    """Rows and shares after adding up under some labels: at most one row for each combination of their indices."""
    own = {c: shares[c].distinct if c in shares else float(sizes[c]) for c in labels}
    places = prod(own.values())
    if places >= rows:
        return rows, {c: shares[c] for c in own if c in shares}
    return places, {c: shares[c].bounded(rows, places / own[c]) for c in own if c in shares}


def estimate(a: tuple[frozenset, float], b: tuple[frozenset, float], keep: set[str], sizes: dict[str, int], of_a: dict[str, Shares] | None = None, of_b: dict[str, Shares] | None = None) -> tuple[float, float, dict[str, Shares]]:
    """Rows of the join of two label sets, and after summing to what is kept, and what is then known of labels. A label that nothing is known of has all its indices, equally often."""
    of_a, of_b = of_a or {}, of_b or {}
    joined, shares = a[1] * b[1], {**of_a, **of_b}
    for c in a[0] & b[0]:
        if c in of_a or c in of_b:
            agree, shares[c] = of_a.get(c, Shares(sizes[c])).met(of_b.get(c, Shares(sizes[c])))
            joined *= agree
        else:
            joined /= max(1, sizes[c])
    kept, shares = _kept(joined, shares, (a[0] | b[0]) & keep, sizes)
    return joined, kept, shares


def order(leaves: list[tuple[frozenset, float]], out: set[str], sizes: dict[str, int], shares: list[dict[str, Shares]] | None = None) -> list[tuple[int, int]]:
    """Pairs to join in turn; each result takes the place after all that exist. Cost: rows joined plus rows kept."""
    live = dict(enumerate(leaves))
    known = dict(enumerate(shares or [{} for _ in leaves]))
    steps: list[tuple[int, int]] = []
    fresh = len(leaves)
    while len(live) > 1:
        ids = sorted(live, key=lambda i: live[i][1])[:EXACT] if len(live) > EXACT else sorted(live)
        outside = set().union(out, *(live[i][0] for i in live if i not in ids))
        best: dict[int, tuple[float, float, frozenset, tuple[int, int] | None, dict[str, Shares]]] = {1 << k: (0.0, live[i][1], live[i][0], None, known[i]) for k, i in enumerate(ids)}
        full = (1 << len(ids)) - 1
        for mask in range(1, full + 1):
            if mask in best:
                continue
            rest = outside.union(*(live[i][0] for k, i in enumerate(ids) if not mask >> k & 1))
            part = (mask - 1) & mask
            while part:
                other = mask ^ part
                if part > other:
                    x, y = best[part], best[other]
                    joined, kept, left = estimate((x[2], x[1]), (y[2], y[1]), rest, sizes, x[4], y[4])
                    cost = x[0] + y[0] + joined + kept
                    if mask not in best or cost < best[mask][0]:
                        best[mask] = (cost, kept, frozenset((x[2] | y[2]) & rest), (part, other), left)
                part = (part - 1) & mask
        at = {1 << k: i for k, i in enumerate(ids)}
        todo, tree = [full], []
        while todo:
            mask = todo.pop()
            if best[mask][3]:
                tree.append(mask)
                todo += best[mask][3]
        tree.reverse()
        for mask in tree if len(live) <= EXACT else tree[:1]:
            a, b = (at[m] for m in best[mask][3])
            steps.append((a, b))
            at[mask] = fresh
            live[fresh], known[fresh] = (best[mask][2], best[mask][1]), best[mask][4]
            del live[a], live[b]
            fresh += 1
    return steps


def contract(leaves: list[Leaf], out: str, sizes: dict[str, int], algebra: Algebra, times: Callable[[Column, Column], Column] | None = None, distributive: bool | None = None, how: str = "inner") -> DataFrame:
    """A DataFrame with i0.. in order of the output labels, and v. times: joins two values in place of the algebra's product."""
    times = times or algebra.times
    distributive = algebra.distributive if distributive is None else distributive
    wanted = set(out)
    if distributive:
        for k, x in enumerate(leaves):
            others = wanted.union(*(y.labels for j, y in enumerate(leaves) if j != k))
            leaves[k] = summed(x, others, algebra, sizes, last=len(leaves) == 1)
    live = dict(enumerate(leaves))
    fresh = len(leaves)
    if algebra.commutative:
        steps = order([(frozenset(x.labels), max(1.0, x.rows)) for x in leaves], wanted, sizes, [x.shares for x in leaves])
    else:
        steps = [(fresh + k - 1 if k else 0, k + 1) for k in range(len(leaves) - 1)]
    # The operand that comes first is the left one.
    place = {k: k for k in live}
    for a, b in steps:
        a, b = sorted((a, b), key=place.__getitem__)
        place[fresh] = place[a]
        x, y = live.pop(a), live.pop(b)
        needed = wanted.union(*(z.labels for z in live.values()))
        shared = [c for c in x.labels if c in y.labels]
        left, right = x.df.withColumnRenamed("v", "v_left"), y.df.withColumnRenamed("v", "v_right")
        joined = left.join(right, [_name(c) for c in shared], how) if shared else left.crossJoin(right)
        labels = tuple(dict.fromkeys(x.labels + y.labels))
        rows, _, _ = estimate((frozenset(x.labels), x.rows), (frozenset(y.labels), y.rows), needed, sizes, x.shares, y.shares)
        shares = {c: x.shares[c].met(y.shares[c])[1] if c in x.shares and c in y.shares else x.shares.get(c, y.shares.get(c)) for c in labels if c in x.shares or c in y.shares}
        z = Leaf(joined.select(*(_name(c) for c in labels), times(F.col("v_left"), F.col("v_right")).alias("v")), labels, rows, x.repeats or y.repeats, shares)
        live[fresh] = summed(z, needed, algebra, sizes, last=not live)
        fresh += 1
    (result,) = live.values()
    result = summed(result, wanted, algebra, sizes)
    df = result.df
    for c in dict.fromkeys(out):
        if c not in result.labels:
            df = repeated(df, _name(c), sizes[c])
    return df.select(*(F.col(_name(c)).alias(f"i{k}") for k, c in enumerate(out)), "v")
