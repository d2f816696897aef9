"""What the planner knows of operands: rows, different indices of each mode, and the indices that are frequent.

One pass over an operand's rows gives all: a count, a sketch of distinct values and a sketch of frequent ones for each mode. How many
rows a join has follows from the shares of the label that both sides have: what frequent indices have in common, and for the others
that the side with fewer of them has its own among the other side's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent indices kept for a mode, and items that the sketch tracks for them.
FREQUENT, TRACKED = 64, 4096


@dataclass(frozen=True)
class Shares:
    """Of a label: how many different indices rows have, and the share of rows of each frequent one. The others are taken to be equally frequent."""

    distinct: float
    frequent: dict[int, float] = field(default_factory=dict)

    @property
    def rest(self) -> float:
        return max(0.0, 1.0 - sum(self.frequent.values()))

    @property
    def others(self) -> float:
        return max(0.0, self.distinct - len(self.frequent))

    def of(self, index: int) -> float:
        own = self.frequent.get(index)
        return own if own is not None else self.rest / self.others if self.others >= 1 else 0.0

    def met(self, other: Shares) -> tuple[float, Shares]:
        """The share of all pairs of rows that agree, and the shares of the indices among those."""
        hot = {v: self.of(v) * other.of(v) for v in {*self.frequent, *other.frequent}}
        # What is left of both sides without the indices that are frequent on either.
        mine = max(0.0, self.rest - sum(self.of(v) for v in other.frequent if v not in self.frequent))
        theirs = max(0.0, other.rest - sum(other.of(v) for v in self.frequent if v not in other.frequent))
        few = max(1.0, self.distinct - len(hot)), max(1.0, other.distinct - len(hot))
        rest = mine * theirs / max(few)
        total = sum(hot.values()) + rest
        if not total:
            return 0.0, Shares(min(self.distinct, other.distinct))
        return total, Shares(min(self.distinct, other.distinct), {v: s / total for v, s in hot.items() if s})

    def bounded(self, rows: float, most: float) -> Shares:
        """After rows have been added up, so that an index has at most so many: shares of what is left of `rows` rows."""
        counts = {v: min(s * rows, most) for v, s in self.frequent.items()}
        others = min(self.rest * rows, most * self.others)
        total = sum(counts.values()) + others
        return Shares(self.distinct, {v: c / total for v, c in counts.items()}) if total else self


@dataclass(frozen=True)
class Statistics:
    rows: float
    modes: tuple[Shares, ...]


def measured(df: DataFrame, keys: Sequence[str]) -> Statistics:
    """Statistics of a relation by its key columns, in one pass. An index counts as frequent if it has more than twice its share were all equal."""
    sketches = []
    for k, key in enumerate(keys):
        sketches += [F.approx_count_distinct(key, 0.02).alias(f"d{k}"), F.expr(f"approx_top_k({key}, {FREQUENT}, {TRACKED})").alias(f"t{k}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    rows = float(row["rows"])
    modes = []
    for k in range(len(keys)):
        distinct = float(max(row[f"d{k}"], 1))
        frequent = {x["item"]: x["count"] / rows for x in row[f"t{k}"] or [] if x["item"] is not None and x["count"] > 2 * rows / distinct}
        modes.append(Shares(max(distinct, len(frequent)), frequent))
    return Statistics(rows, tuple(modes))
