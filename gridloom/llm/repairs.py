"""Conversation structure repair: error-correcting Earley parsing over a weighted grammar of roles.

A conversation C is empty, or pairs P of turns T (user, assistant), after a system turn or not:

    C -> nothing | P | s P        P -> T | P T        T -> u a

by the initials of roles. To make any sequence of rows one, rows are kept, deleted or given another role, and empty user and
assistant turns are inserted, each at a cost (COSTS); what can't stay as it is (blank rows, repeated ones) must be deleted, and rows that end
in the middle of a sentence add a cost where they stay. An item of the chart is a rule, a place in it and the column where it began, with the least
(cost, audit) of all ways to it, audit being the edits' initials so far. Of items that differ in their column of origin
only the least is kept, as what can follow is the same. A completed C in the last column gives cost and audit, and the audit gives the repaired rows.

On Spark: rows are reduced to what the parser reads (initial, faults, a 128-bit hash of the text), equal ones to one with a
count, and a row is a repeat if its conversation has the same role and text at an earlier turn, which is a grouped minimum and
a join. These narrow rows are sorted by range over all conversations, so that a long one is spread over tasks; each task parses its part of a
conversation from every state in which that part can begin, with bounded columns at once. The parts' tables of (cost, audit) from state to state are put
together in order, since the least path through parts is made of least paths of parts. The texts then meet the audit of their conversation in one pass
over sorted rows, which holds no conversation's texts: that order, and a digest of it, are one conversation's and not divisible.

Defined results: nulls in role or text are one space; null turns come first; rows of one turn are taken by role, then by a hash of their text, equal rows together; a null
conversation id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Left side and right side of each rule; lower-case symbols are initials of roles.
RULES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
#: What a row that ends within a sentence adds where it stays.
TRUNCATED = 3
NAMES = {"u": "user", "a": "assistant"}
#: Columns of a chart held at once.
COLUMNS = 512

Item = tuple[int, int]
#: By item: cost, audit, column of origin.
Column_ = dict[Item, tuple[int, str, int]]

_NEXT = {(k, d): (own[d] if d < len(own) else "") for k, (_, own) in enumerate(RULES) for d in range(len(own) + 1)}
_OF = {left: [k for k, (own, _) in enumerate(RULES) if own == left] for left in "CPT"}
#: States between rows, and the item that stands for each: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_EXITS = {START: [(0, 0)], AFTER_S: [(2, 1)], AFTER_U: [(5, 1)], AFTER_A: [(1, 1), (2, 2)]}
#: Items from which a chart goes on in each state. After u there is a turn to complete, whose callers are in column 0 but are not open for another turn.
_ENTRIES = {START: [(0, 0), (1, 0), (2, 0)], AFTER_S: [(2, 1)], AFTER_U: [(5, 1)], AFTER_A: [(1, 1), (1, 0)]}
_CALLERS: Column_ = {(1, 0): (0, "", 0), (3, 0): (0, "", 0), (4, 0): (0, "", 0)}


def _close(chart: list[Column_]) -> None:
    """Prediction, completion and insertion in the last column until nothing gets less."""
    column, here = chart[-1], len(chart) - 1
    todo = list(column)

    def offer(item: Item, cost: int, audit: str, origin: int) -> None:
        held = column.get(item)
        if held is None or (cost, audit) < held[:2]:
            column[item] = (cost, audit, origin)
            todo.append(item)

    while todo:
        item = todo.pop()
        cost, audit, origin = column[item]
        after = _NEXT[item]
        if not after:
            left = RULES[item[0]][0]
            for caller, (_, _, began) in list(chart[origin].items()):
                if _NEXT[caller] == left:
                    offer((caller[0], caller[1] + 1), cost, audit, began)
        elif after in _OF:
            for k in _OF[after]:
                offer((k, 0), cost, audit, here)
        elif after in NAMES:
            offer((item[0], item[1] + 1), cost + COSTS["I"], audit + "I", origin)


def _scan(column: Column_, initial: str, gone: bool, extra: int) -> Column_:
    """The next column, past a row: kept, given another role, or deleted."""
    out: Column_ = {}

    def offer(item: Item, cost: int, audit: str, origin: int) -> None:
        held = out.get(item)
        if held is None or (cost, audit) < held[:2]:
            out[item] = (cost, audit, origin)

    for item, (cost, audit, origin) in column.items():
        after = _NEXT[item]
        wants = after != "" and after not in _OF
        if wants or RULES[item[0]][0] == "C":
            offer(item, cost + COSTS["D"], audit + "D", origin)
        if wants and not gone:
            if initial == after:
                offer((item[0], item[1] + 1), cost + extra, audit + "K", origin)
            elif after in NAMES:
                offer((item[0], item[1] + 1), cost + COSTS["R"] + extra, audit + "R", origin)
    return out


#: How a row is written for the parser: its initial and d (must go), t (truncated) or a dot.
Row = str


def _parsed(rows: tuple[Row, ...], entry: int) -> tuple[tuple[int, str] | None, ...]:
    """The least (cost, audit) of some rows from a state to each state."""
    chart: list[Column_] = [_CALLERS, {item: (0, "", 0 if entry == AFTER_U else 1) for item in _ENTRIES[entry]}]
    _close(chart)
    for row in rows:
        chart.append(_scan(chart[-1], row[:-1], row[-1] == "d", TRUNCATED if row[-1] == "t" else 0))
        _close(chart)
    found = [[chart[-1][item][:2] for item in _EXITS[state] if item in chart[-1]] for state in _EXITS]
    return tuple(min(f, default=None) for f in found)


_remembered = lru_cache(200_000)(_parsed)


def parsed(rows: tuple[Row, ...], entry: int = START) -> tuple[tuple[int, str] | None, ...]:
    return _remembered(rows, entry) if len(rows) <= 12 else _parsed(rows, entry)


#: From state to state: (cost, audit), or None where there is no way.
Table = list[list[tuple[int, str] | None]]


def through(a: Table, b: Table) -> Table:
    """First a, then b."""
    out: Table = []
    for row in a:
        ways = [[(x[0] + b[m][q][0], x[1] + b[m][q][1]) for m, x in enumerate(row) if x and b[m][q]] for q in range(4)]
        out.append([min(w, default=None) for w in ways])
    return out


NOTHING: Table = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]


class Part:
    """Consecutive rows of a conversation: figures, and a table from state to state. whole: nothing can come before them."""

    __slots__ = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "table", "open", "whole")

    def __init__(self, whole: bool):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.table: Table = [NOTHING[0], *([[None] * 4] * 3)] if whole else NOTHING
        self.open: list[Row] = []
        self.whole = whole

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        self.blank += fault == "b"
        self.duplicate += fault == "r"
        self.truncated += fault == "t"
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.open.append((initial if initial in "sua" else "-") + ("d" if fault in "br" else fault))
        if len(self.open) == COLUMNS:
            self.close()

    def close(self) -> None:
        if self.open:
            rows = tuple(self.open)
            from_start = self.whole and self.table[START] == NOTHING[START]
            self.table = through(self.table, [parsed(rows, p) if p == START or not from_start else [None] * 4 for p in range(4)])
            self.open = []

    def figures(self) -> list[int | None]:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, *(x[0] if x else None for row in self.table for x in row)]

    def audits(self) -> list[str | None]:
        return [self.first, self.last, *(x[1] if x else None for row in self.table for x in row)]


class Whole:
    """A conversation, part by part in order."""

    def __init__(self) -> None:
        self.counts = [0] * 5
        self.low = self.high = self.last = None
        self.table: Table = [NOTHING[0]]

    def add(self, figures: list[int | None], audits: list[str | None]) -> None:
        for k in range(5):
            self.counts[k] += figures[k]
        low, high = figures[5:7]
        if low is not None:
            self.counts[4] -= low == self.high
            self.low, self.high = low if self.low is None else self.low, high
        if self.last is not None:
            self.counts[3] += self.last + audits[0] not in ("su", "ua", "au")
        self.last = audits[1]
        ways = [(c, a) if a is not None else None for c, a in zip(figures[7:], audits[2:])]
        self.table = through(self.table, [ways[4 * p : 4 * p + 4] for p in range(4)])

    def result(self) -> tuple[int, int, int, int, int, int, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        cost, audit = min(x for x in (self.table[0][START], self.table[0][AFTER_A]) if x)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts[4]
        return (gaps, *self.counts[:4], cost, audit)


class Repair:
    """Follows an audit along a conversation's rows and gives its repaired ones: (edit, role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.wants = audit, 0, "u"

    def _turn(self) -> str:
        own, self.wants = self.wants, "a" if self.wants == "u" else "u"
        return NAMES[own]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._turn(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if role[:1] in NAMES:
                self._turn()
            yield edit, role, text
        elif edit == "R":
            yield edit, self._turn(), text


_ORDER = ["c", "has", "t", "r", "k1", "k2"]


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, has, t, r, k1, k2, x): has says whether the row has a turn, t is 0 where it hasn't; k1 and k2 are hashes of the text x."""
    x = F.coalesce(F.col(text), F.lit(" "))
    plain = rows.select(F.col(conv).alias("c"), F.col(turn).isNotNull().alias("has"), F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("r"), x.alias("x"))
    return plain.select("c", "has", "t", "r", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), F.col("x")).alias("k2"), "x")


def _parts(rows: DataFrame) -> DataFrame:
    """Parts of conversations with figures and tables, each under the place of its first row."""
    end = F.rtrim(F.col("x"), F.lit(common.WS))
    fault = F.when(end == "", "b").when(F.right(end, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")
    narrow = rows.select(*_ORDER, fault.alias("fault")).groupBy(*_ORDER).agg(F.count(F.lit(1)).alias("n"), F.first("fault").alias("fault"))
    first = narrow.groupBy("c", "r", "k1", "k2").agg(F.min(F.struct("has", "t")).alias("first"))
    first = first.select(F.col("c").alias("fc"), F.col("r").alias("fr"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    same = F.col("c").eqNullSafe(F.col("fc")) & (F.col("r") == F.col("fr")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
    seen = narrow.join(first, same).select(*_ORDER, "n", "fault", (F.struct("has", "t") != F.col("first")).alias("later"))
    kind = rows.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, part, begun, out = None, None, None, False, []

        def batch_of() -> pa.RecordBatch:
            keys = list(zip(*(p for p, _ in out)))
            for _, p in out:
                p.close()
            return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(keys, kinds)), pa.array([p.figures() for _, p in out], pa.list_(pa.int64())), pa.array([p.audits() for _, p in out], pa.list_(pa.string()))], [*_ORDER, "figures", "audits"])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][:6]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                c, has, t, r, _, _, n, fault, later = row
                if not begun or c != held:
                    if part is not None:
                        out.append((place, part))
                        if len(out) >= 2048:
                            yield batch_of()
                            out.clear()
                    # Only a partition's first conversation can have rows before.
                    held, place, part, begun = c, row[:6], Part(begun), True
                for k in range(n):
                    part.add(t if has else None, r, "r" if fault != "b" and (later or k) else fault)
        if part is not None:
            out.append((place, part))
            yield batch_of()

    ranged = seen.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(*_ORDER, "n", "fault", "later")
    return ranged.mapInArrow(run, f"c {kind}, has boolean, t long, r string, k1 long, k2 long, figures array<long>, audits array<string>")


def _passed(rows: DataFrame, conv: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    """Conversations, or their repaired turns, from one pass over each one's parts and then its rows."""
    rows = _rows(rows, conv, turn, role, text)
    kind = rows.schema["c"].dataType.simpleString()
    none = F.lit(None)
    both = _parts(rows).select(*_ORDER, none.cast("string").alias("x"), "figures", "audits").unionByName(rows.select(*_ORDER, "x", none.cast("array<long>").alias("figures"), none.cast("array<string>").alias("audits")))
    both = both.withColumn("step", F.col("figures").isNull())
    ordered = both.repartition("c").sortWithinPartitions("c", "step", *_ORDER[1:]).select("c", "step", "r", "x", "figures", "audits")
    names = ["conv", "position", "role", "text", "edit"] if turns else ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = f"conv {kind}, position long, role string, text string, edit string" if turns else f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, begun, key_type, size = None, False, None, 0
        whole, repair, digest, position = Whole(), None, hashlib.sha256(), 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            numbers, strings = pa.int64(), pa.string()
            kinds = [key_type, numbers, *([strings] * 3)] if turns else [key_type, *([numbers] * 6), strings, strings]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            out.clear()
            return made

        def take(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position, size
            for edit, role, text in found:
                if turns:
                    out.append((held, position, role, text, edit))
                    size += len(text)
                else:
                    digest.update((b"\n" if position else b"") + f"{role}:{text}".encode())
                position += 1

        def finish() -> None:
            take(repair.inserted())
            if not turns:
                out.append((held, *whole.result(), digest.hexdigest()))

        for batch in batches:
            key_type = batch.schema.field(0).type
            for c, step, r, x, figures, audits in zip(*(col.to_pylist() for col in batch.columns)):
                if not begun or c != held:
                    if begun:
                        finish()
                    held, begun = c, True
                    whole, repair, digest, position = Whole(), None, hashlib.sha256(), 0
                if not step:
                    whole.add(figures, audits)
                    continue
                if repair is None:
                    repair = Repair(whole.result()[-1])
                take(repair.row(r, x))
                if len(out) >= 8192 or size > 1 << 24:
                    size = 0
                    yield batch_of()
        if begun:
            finish()
        if out:
            yield batch_of()

    return ordered.mapInArrow(run, schema)


def reports(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation: conv, gaps in its turns, blank, repeated and truncated rows, illegal changes of role, the repair's cost and audit, and the SHA-256 of the repaired turns."""
    return _passed(rows, conv, turn, role, text, False)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns themselves: conv, position from 0, role, text and what was done (K, R or I)."""
    return _passed(rows, conv, turn, role, text, True)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the damage that op12 repairs: by a checksum of conversation and turn rows are dropped, emptied, rid of sentence ends, repeated or given to the user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text, role = or_space("text"), or_space("role")
    of_kind = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return of_kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations")
    found = reports(damaged(rows))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
