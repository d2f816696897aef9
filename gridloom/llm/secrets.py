"""Secret scans: fixed base patterns, and formats learned from labelled credentials by grammar inference.

Labelled credentials (kind, value) of each kind are put into a prefix tree with counts; states whose outgoing symbol and
end frequencies are statistically compatible (Hoeffding bound, on them and on all states below) are merged, which gives
a probabilistic automaton for the kind's format. Every candidate (a maximal run of 12 or more token characters that no
base span touches) is scored by the log-likelihood ratio of the automaton against a character model of ordinary long
tokens; scores above the kind's cutoff, calibrated on labelled values kept out and on ordinary tokens, become spans.

Ordinary tokens are all distinct candidates but the format-like ones: those that an automaton finds about as likely, a character, as
the labelled values kept out, and likelier than a character model of all candidates does. Both models and the histogram of
scores are sums over the candidates, of any number and length.

Without labels given, the base patterns' own matches are the labelled credentials: a bottom-k sample by hash, the same
however rows are partitioned, of at most `sample` distinct values of each kind and `longest` characters each, as an automaton's states grow
with them (bounds of the training rows only; candidates, matching and scoring cover all).

Defined results: a null text is an empty one and has no spans; rows are scanned one by one, repeated ones alike; with
no labelled values of a kind no spans of that format are added; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base patterns; fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]], list[str]]:
    """The base spans, the candidate runs, and for each span the credential in it (of an assignment its value)."""
    found: list[Span] = []
    values: list[str] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), m.end(), "assign"))
                values.append(m.group(2))
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    for a, b in runs:
        # Runs of the other two patterns' characters that are long enough lie within such a run.
        for pattern, kind, least in ((ACCESS, "access", 16), (HEX, "hex", 32)):
            if b - a >= least:
                for m in pattern.finditer(text, a, b):
                    if m.end() - m.start() >= least:
                        found.append((m.start(), m.end(), kind))
                        values.append(m.group())
    order = sorted(range(len(found)), key=lambda i: (found[i][0], KINDS.index(found[i][2])))
    return [found[i] for i in order], runs, [values[i] for i in order]


def free_runs(runs: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """Candidate runs that no span touches. Both lists are sorted by start."""
    if not spans:
        return runs
    out, reach, k = [], -1, 0
    for a, b in runs:
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


class Automaton:
    """A probabilistic automaton: transitions[state][symbol] = (next state, log2 probability), ends[state] = log2 probability."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        counts, ends, children = [0], [0], [{}]
        for v in sorted(values):
            s = 0
            counts[0] += 1
            for c in v:
                if c not in children[s]:
                    children[s][c] = len(counts)
                    counts.append(0)
                    ends.append(0)
                    children.append({})
                s = children[s][c]
                counts[s] += 1
            ends[s] += 1
        self._counts, self._ends, self._children = counts, ends, children
        self._width = math.sqrt(0.5 * math.log(2 / alpha))
        self._arcs = [{c: counts[t] for c, t in kids.items()} for kids in children]
        self._merge()
        self._freeze()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n1, n2 = self._counts[x], self._counts[y]
            if not n1 or not n2:
                continue
            if self._differ(self._ends[x], n1, self._ends[y], n2):
                return False
            for c in self._arcs[x].keys() | self._arcs[y].keys():
                if self._differ(self._arcs[x].get(c, 0), n1, self._arcs[y].get(c, 0), n2):
                    return False
            for c, t in self._children[y].items():
                if c in self._children[x]:
                    todo.append((self._children[x][c], t))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree of a state that isn't settled yet to a state."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self._counts[x] += self._counts[y]
            self._ends[x] += self._ends[y]
            for c, n in self._arcs[y].items():
                self._arcs[x][c] = self._arcs[x].get(c, 0) + n
            for c, t in self._children[y].items():
                if c in self._children[x]:
                    todo.append((self._children[x][c], t))
                else:
                    self._children[x][c] = t

    def _merge(self) -> None:
        """Settle states breadth first: each is merged with the first settled state it is compatible with, or settled itself."""
        settled = [0]
        known = {0}
        while True:
            edge = next(((s, c, t) for s in settled for c, t in sorted(self._children[s].items()) if t not in known), None)
            if edge is None:
                break
            s, c, t = edge
            same = next((r for r in settled if self._compatible(r, t)), None)
            if same is None:
                settled.append(t)
                known.add(t)
            else:
                self._children[s][c] = same
                self._fold(same, t)
        self.settled = settled

    def _freeze(self) -> None:
        name = {s: i for i, s in enumerate(self.settled)}
        self.transitions, self.ends = [], []
        for s in self.settled:
            n = self._counts[s] + 0.5
            self.transitions.append({c: (name[t], math.log2((self._arcs[s].get(c, 0) or 0.5) / n)) for c, t in self._children[s].items()})
            self.ends.append(math.log2((self._ends[s] + 0.5) / (n + 0.5)))
        # A symbol of the format that a state hasn't shown is unlikely there, not impossible: it leads where it mostly leads.
        usual: dict[str, tuple[int, int]] = {}
        for s in self.settled:
            for c, t in self._children[s].items():
                usual[c] = max(usual.get(c, (0, 0)), (self._arcs[s].get(c, 0), name[t]))
        for s, own in zip(self.settled, self.transitions):
            unseen = math.log2(0.5 / (self._counts[s] + 0.5))
            for c, (_, t) in usual.items():
                own.setdefault(c, (t, unseen))
        del self._counts, self._ends, self._children, self._arcs

    def likelihood(self, value: str) -> float | None:
        """log2 probability of the value; None if it has a symbol that the format never has."""
        s = total = 0
        for c in value:
            step = self.transitions[s].get(c)
            if step is None:
                return None
            s, p = step
            total += p
        return total + self.ends[s]


def _class(c: str) -> str:
    return "^" if c == "^" else "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "/"


def pair_counts(values: Iterable[str]) -> Counter[str]:
    """Counts of pairs of character classes (two letters) and of characters (one letter) of values; they add up over parts."""
    counts: Counter[str] = Counter()
    for v in values:
        kinds = "^" + "".join(map(_class, v))
        counts.update(map("".join, zip(kinds, kinds[1:])))
        counts.update(v)
    return counts


class Background:
    """Ordinary long tokens: pairs of character classes, and characters within their class, add-one smoothed. Coarser than pairs of characters, so that a few secrets among the tokens don't make their own characters ordinary."""

    def __init__(self, counts: dict[str, int]):
        pairs = {k: n for k, n in counts.items() if len(k) == 2}
        own = {k: n for k, n in counts.items() if len(k) == 1}
        firsts: dict[str, int] = {}
        of_class: dict[str, int] = {}
        for k, n in pairs.items():
            firsts[k[0]] = firsts.get(k[0], 0) + n
            of_class[k[1]] = of_class.get(k[1], 0) + n
        members = {y: sum(_class(b) == y for b in ALPHABET) for y in "aA0/"}
        within = {b: (own.get(b, 0) + 1) / (of_class.get(_class(b), 0) + members[_class(b)]) for b in ALPHABET}
        between = {x + y: (pairs.get(x + y, 0) + 1) / (firsts.get(x, 0) + 4) for x in "^aA0/" for y in "aA0/"}
        self.pairs = {a + b: math.log2(between[_class(a) + _class(b)] * within[b]) for a in "^" + ALPHABET for b in ALPHABET}

    def likelihood(self, value: str) -> float:
        return sum(self.pairs[a + b] for a, b in zip("^" + value, value))


#: Least score of a secret, and of a format-like token, in bits.
FLOOR = 10.0
#: A format-like token takes at most so many times the bits a character that the labelled values kept out take.
SLACK = 1.25
#: Scores are counted in steps of this many bits.
STEP = 0.25


class FormatModel:
    """One automaton for each kind, the background, and each kind's cutoff."""

    def __init__(self, labelled: dict[str, list[str]], candidates: Candidates):
        kept_out = lambda v: xxhash.xxh64_intdigest(v, seed=1) % 4 == 0
        self.kinds: dict[str, tuple[Automaton, float, int]] = {}
        self.usual: dict[str, float] = {}
        good: dict[str, list[str]] = {}
        for kind, values in sorted(labelled.items()):
            values = [v for v in values if len(v) >= 12 and all(c in ALPHABET for c in v)]
            fit = [v for v in values if not kept_out(v)]
            if len(fit) < 8:
                continue
            automaton = Automaton(fit)
            good[kind] = [v for v in [v for v in values if kept_out(v)] or fit if automaton.likelihood(v) is not None]
            each = sorted(automaton.likelihood(v) / len(v) for v in good[kind])
            self.kinds[kind] = (automaton, math.inf, min(map(len, fit)))
            self.usual[kind] = each[len(each) // 50] * SLACK if each else math.inf
        if not self.kinds:
            return
        self.background = Background(candidates.counts(None))
        self.background = Background(candidates.counts(self))
        plain = candidates.scores(self)
        for kind, (automaton, _, least) in self.kinds.items():
            own = sorted(automaton.likelihood(v) - self.background.likelihood(v) for v in good[kind])
            self.kinds[kind] = (automaton, max(own[len(own) // 50] * 0.8 if own else math.inf, quantile(plain.get(kind, {}), 0.995) + 1.0, FLOOR), least)

    def format_like(self, value: str) -> bool:
        """Whether an automaton finds the value about as likely, a character, as labelled ones, and likelier by FLOOR bits than the background does."""
        for kind, (automaton, _, least) in self.kinds.items():
            if len(value) >= least and (p := automaton.likelihood(value)) is not None:
                if p >= self.usual[kind] * len(value) and p - self.background.likelihood(value) >= FLOOR:
                    return True
        return False

    def steps(self, value: str) -> list[tuple[str, int | None]]:
        """The kinds that the value is long enough for, and its score under each in whole steps (None: it has a symbol that the format never has)."""
        own = [(kind, automaton.likelihood(value)) for kind, (automaton, _, least) in self.kinds.items() if len(value) >= least]
        back = self.background.likelihood(value) if any(p is not None for _, p in own) else 0.0
        return [(kind, None if p is None else math.ceil((p - back) / STEP)) for kind, p in own]

    def format_of(self, value: str) -> str | None:
        """The kind under which the value is likeliest, if above its cutoff."""
        best, kind = -math.inf, None
        back = None
        for k, (automaton, cutoff, least) in self.kinds.items():
            if len(value) >= least and (p := automaton.likelihood(value)) is not None:
                back = self.background.likelihood(value) if back is None else back
                if p - back >= cutoff and p > best:
                    best, kind = p, k
        return kind


def quantile(histogram: dict[int | None, int], share: float) -> float:
    """The score in steps below or at which this share of the counted ones lies."""
    left = int(sum(histogram.values()) * share)
    for step in sorted(histogram, key=lambda s: -math.inf if s is None else s):
        left -= histogram[step]
        if left <= 0:
            return -math.inf if step is None else step * STEP
    return -math.inf


class Candidates:
    """All distinct candidates (a table with a column value), of which only sums reach the driver."""

    def __init__(self, values: DataFrame):
        self.values = values

    def _summed(self, run, schema: str) -> list:
        *by, n = schema.split(", ")
        return self.values.select("value").mapInArrow(run, schema).groupBy(*(c.split()[0] for c in by)).agg(F.sum("n").alias("n")).collect()

    def counts(self, model: FormatModel | None) -> dict[str, int]:
        """Pair counts of all candidates, or of those that aren't format-like to the model."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for batch in batches:
                total.update(pair_counts(v for v in batch.column(0).to_pylist() if model is None or not model.format_like(v)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["what", "n"])

        return {r["what"]: r["n"] for r in self._summed(run, "what string, n long")}

    def scores(self, model: FormatModel) -> dict[str, dict[int | None, int]]:
        """For each kind a histogram of the scores of candidates that aren't format-like."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter[tuple[str, int | None]] = Counter()
            for batch in batches:
                for v in batch.column(0).to_pylist():
                    if not model.format_like(v):
                        total.update(model.steps(v))
            rows = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int64()), pa.array(list(total.values()), pa.int64())], ["kind", "step", "n"])

        out: dict[str, dict[int | None, int]] = {}
        for r in self._summed(run, "kind string, step long, n long"):
            out.setdefault(r["kind"], {})[r["step"]] = r["n"]
        return out


#: Distinct candidates that a task remembers; then it forgets all and starts again.
REMEMBERED = 100_000


def rank(value: str) -> int:
    """The value's place in a sample: what Spark's xxhash64 gives for it."""
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def sample_credentials(docs: DataFrame, text: str, sample: int, longest: int = 512) -> tuple[dict[str, list[str]], Candidates]:
    """For each base kind the `sample` distinct values of smallest hash and at most `longest` characters, of which tasks send so many at most; and all distinct candidates."""

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list[tuple[int, str]]] = {}
        seen: dict[str, set[str]] = {}
        known: set[str] = set()

        def offer(kind: str, value: str) -> None:
            heap, own = heaps.setdefault(kind, []), seen.setdefault(kind, set())
            if len(value) > longest or value in own:
                return
            item = (-rank(value), value)
            if len(heap) < sample:
                heapq.heappush(heap, item)
                own.add(value)
            elif item > heap[0]:
                own.discard(heapq.heapreplace(heap, item)[1])
                own.add(value)

        def batch_of(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])

        for batch in batches:
            new = []
            for t in batch.column(0).to_pylist():
                if t:
                    spans, runs, values = base_spans(t)
                    for (_, _, kind), value in zip(spans, values):
                        offer(kind, value)
                    for a, b in free_runs(runs, spans):
                        if (value := t[a:b]) not in known:
                            new.append(("", value))
                            if len(value) <= 64:
                                known.add(value)
            if len(known) > REMEMBERED:
                known.clear()
            yield batch_of(new)
        yield batch_of([(k, v) for k, heap in heaps.items() for _, v in heap])

    found = common.materialise(docs.select(text).mapInArrow(harvest, "kind string, value string").distinct(), "credentials")
    labelled: dict[str, list[str]] = {}
    for kind in KINDS:
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        labelled[kind] = [r["value"] for r in rows]
    return labelled, Candidates(found.where("kind = ''"))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(text: str, model: FormatModel | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and learned spans together, both by start, then kind."""
    spans, runs, _ = base_spans(text)
    if not model or not model.kinds:
        return spans, spans
    more = [(a, b, f"format_{k}") for a, b in free_runs(runs, spans) if (k := model.format_of(text[a:b]))]
    return spans, sorted([*spans, *more], key=lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[2]))


def learn(docs: DataFrame, text: str = "text", sample: int = 400, longest: int = 512) -> FormatModel:
    return FormatModel(*sample_credentials(docs, text, sample, longest))


def scan(docs: DataFrame, model: FormatModel, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, n_assign, n_access, n_hex, n_format, base, spans): one row for each input row; spans as kind:start:end in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base, spans = all_spans(t or "", model)
                n = [sum(s[2] == k for s in base) for k in KINDS]
                out.append((*n, len(spans) - len(base), digest(base), digest(spans)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc", "n_assign", "n_access", "n_hex", "n_format", "base", "spans"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_assign long, n_access long, n_hex long, n_format long, base string, spans string")


def redacted(text: str, model: FormatModel | None, mark: str = "[secret]") -> str:
    """The text with every span (spans that touch or overlap as one) replaced by a mark."""
    _, spans = all_spans(text, model)
    if not spans:
        return text
    out, at, reach = [], 0, -1
    for a, b, _ in spans:
        if a > reach:
            out += [text[at:a], mark]
        at = reach = max(reach, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: FormatModel, text: str = "text") -> DataFrame:
    """docs with the secrets of column text replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            texts = pa.array([t if t is None else redacted(t, model) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if j == i else batch.column(j) for j in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = scan(docs, learn(docs))
    return rows.select(F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_format")
