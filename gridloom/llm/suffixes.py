"""Suffix-array dedup by prefix-free parsing: bytes covered by a string of `length` bytes that also starts elsewhere go.

Parsing. A rolling hash of TRIGGER bytes runs over each document; the least hash of every window of length - TRIGGER + 1 places is a
trigger (the first of equal ones). So each string of `length` bytes has exactly one trigger, found from its own bytes alone, and equal
strings have it at the same place. The strings with one trigger are the suffixes of a phrase: the bytes from the first
such string's start to the last one's end.

Dictionary. Phrases are named by two hashes of 126 bits together, and equal ones counted; a phrase that occurs twice or more repeats with
all its suffixes. Distinct phrases with the same trigger string may share some suffixes: one occurrence of each is read from the texts. As
strings of different triggers differ, the dictionary's suffix array falls apart by trigger: each task builds the suffix arrays of its triggers' phrases,
to a depth of `length` bytes, and neighbours that are equal so far repeat. The few triggers that very many phrases share are spread over
tasks: each sorts its part, and what is left meets by the suffixes' hashes.

Parse. What repeats is handed back to all occurrences of each phrase, and every document's runs are merged and cut out. A string lies in
one phrase, so its place in corpus order among others of `length` bytes follows from the dictionary's order; the parse decides only how often it occurs.

`corpus_order(texts)` is the same parsing on one machine with the whole order, for small corpora: suffix arrays of the dictionary and of the parse are
combined into the suffix array of the corpus.

Only hashes are shuffled, besides the texts twice (to read the shared phrases, and to cut). Hot triggers, phrases and
suffixes are counted before the shuffle and joined slot by slot.

Defined results: a null text is an empty one; a text shorter than `length` keeps all its bytes; each row is a document of its own, so
repeated rows repeat each other; rows with equal ids are told apart by their text's hash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRIGGER = 64
SLOTS = 64
#: Phrases with one trigger that are held side by side in one task; those of more common triggers are shuffled by string.
TOGETHER = 32
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15),)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses, modulo 2^64."""
    up, down = _powers.get(base, (np.zeros(0, _U), np.zeros(0, _U)))
    if len(up) <= n:
        size = max(2 * n, 1 << 16) + 1
        b = int(_BASES[base])
        inverse = pow(b, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(x))])) for x in (b, inverse))
        _powers[base] = (up, down)
    return up, down


class Rolling:
    """Hashes of any substring from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, self.down = _power(base, len(data))
        self.sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * self.up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


#: Primes below 2^31 and a base for each.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1664525007))
#: Places summed before a reduction: a term is below 2^39.
_CHUNK = 1 << 24
_prime_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th base's powers 0..n and their inverses, modulo its prime."""
    up, down = _prime_powers.get(k, (np.zeros(0, _U), np.zeros(0, _U)))
    if len(up) <= n:
        p, b = _PRIMES[k]
        out = []
        for x in (b, pow(b, -1, p)):
            row, step = np.ones(1, _U), x
            # Twice as many powers with each product.
            while len(row) <= max(2 * n, 1 << 16):
                row = np.concatenate([row, row * _U(step) % _U(p)])
                step = step * step % p
            out.append(row)
        up, down = out
        _prime_powers[k] = (up, down)
    return up, down


class PrimeRolling:
    """As Rolling, modulo two primes (62 bits): unlike powers of two, they have no texts, such as Thue-Morse words, whose hashes meet for every base."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        for k, (p, _) in enumerate(_PRIMES):
            up, down = _prime_power(k, len(data))
            sums = np.empty(len(data) + 1, _U)
            sums[0] = total = _U(0)
            for a in range(0, len(data), _CHUNK):
                part = np.cumsum((data[a : a + _CHUNK].astype(_U) + _U(1)) * up[a : a + _CHUNK][: len(data) - a]) + total
                sums[a + 1 : a + 1 + len(part)] = part
                total = part[-1] % _U(p)
            self.parts.append((sums, down, _U(p)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        (x, y) = ((sums[end] % p + p - sums[start] % p) % p * down[start] % p for sums, down, p in self.parts)
        return _mixed(x << _U(31) | y)


def triggers(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many hashes the place of the least, the first of equal ones (sliding minimum by block prefixes and suffixes)."""
    n = len(hashes) - window + 1
    place = np.arange(len(hashes), dtype=_U)
    bits = _U(max(1, int(len(hashes)).bit_length()))
    packed = (hashes >> bits) << bits | place
    pad = -len(packed) % window
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, _U)]).reshape(-1, window)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[window - 1 : window - 1 + n])
    return (least & ((_U(1) << bits) - _U(1))).astype(np.int64)


def phrases(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """(first, count, trigger place, trigger hash, rolling hash) of each phrase of one text: its strings start at first .. first + count - 1."""
    rolling = Rolling(data, 0)
    k = np.arange(len(data) - TRIGGER + 1)
    hashes = rolling.of(k, k + TRIGGER)
    at = triggers(hashes, length - TRIGGER + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    place = at[first]
    return first, count, place, hashes[place], rolling


def named(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Names of phrases: of their bytes, and of where the trigger is in them."""
    other = PrimeRolling(data)
    end = first + count - 1 + length
    own = (place - first).astype(_U)
    return _mixed(rolling.of(first, end) ^ _mixed(own + _U(1))), _mixed(other.of(first, end) + _mixed(own + _U(7)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def parsed(docs: DataFrame, text: str, doc: str, length: int) -> DataFrame:
    """(doc, tk, first, count, t, p1, p2): every phrase's document and text hash, its strings, trigger hash and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tk", "first", "count", "t", "p1", "p2"]
        for batch in batches:
            docs_, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            parts: list[tuple] = []
            rows = 0
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if t is not None and len(t) >= length:
                    data = np.frombuffer(t, np.uint8)
                    first, count, place, hashes, rolling = phrases(data, length)
                    p1, p2 = named(data, first, count, place, length, rolling)
                    parts.append((np.full(len(first), docs_[i]), np.full(len(first), keys[i]), first, count.astype(np.int32), hashes, p1, p2))
                    rows += len(first)
                if rows > 100_000:
                    yield table(parts, names)
                    parts, rows = [], 0
            yield table(parts, names)

    def table(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names)
        c = [np.concatenate(x) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c[0].astype(np.int64)), pa.array(c[1].astype(np.int64)), pa.array(c[2]), pa.array(c[3]), _signed(c[4]), _signed(c[5]), _signed(c[6])], names)

    return _rows(docs, text, doc).mapInArrow(run, "doc long, tk long, first long, count int, t long, p1 long, p2 long")


def _rows(docs: DataFrame, text: str, doc: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tk"))


def _slotted(rows: DataFrame, *key: str) -> DataFrame:
    """Keys with two rows or more, once for each slot that has rows of them; slot must be a column. Counted before the shuffle."""
    found = rows.groupBy(*key).agg(F.sum("n").alias("total"), F.bit_or(F.expr("shiftleft(1L, slot)")).alias("slots"))
    return found.where("total > 1").select(*key, "total", F.explode(F.expr(f"filter(sequence(0, {SLOTS - 1}), s -> getbit(slots, s) = 1)")).alias("slot"))


def _wanted(docs: DataFrame, lists: DataFrame, text: str, doc: str, how: str) -> DataFrame:
    """(doc, text, tk, list): lists, (doc, tk, list), belong to a document and text hash, so that documents of one id (null, say) have lists of their own."""
    return _rows(docs, text, doc).join(lists.select("doc", "tk", "list").hint("merge"), ["doc", "tk"], how).select("doc", "text", "tk", "list")


_ENTRY = "t long, doc long, tk long, first long, count int, n long"


def read_phrases(docs: DataFrame, wanted: DataFrame, text: str, doc: str, length: int) -> DataFrame:
    """Dictionary entries with their phrase's bytes. wanted: (doc, tk, list of entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "doc", "tk", "first", "count", "n", "phrase"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            rows = []
            for d, t, tk, list_ in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if t is None or len(t) < length:
                    continue
                for x in list_.as_py():
                    a = x["first"]
                    rows.append((x["t"], d, tk, a, x["count"], x["n"], t[a : a + x["count"] - 1 + length]))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _wanted(docs, wanted, text, doc, "inner").mapInArrow(run, f"{_ENTRY}, phrase binary")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each place the rank of the `length` bytes from it in their order, equal for equal ones (bytes past the end count as 0): the suffix array to that depth, by doubling from eight bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    rank = np.zeros(n + length, _U)
    for k in range(min(8, length)):
        rank = rank << _U(8) | padded[k : k + n + length]
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(_U)
    rank, width = dense(rank), min(8, length)
    while width < length:
        # The last step may overlap: where the first parts are equal, only what the second one adds decides.
        step = min(width, length - width)
        second = np.concatenate([rank[step:], np.zeros(step, _U)])
        rank, width = dense(rank << _U(32) | second), width + step
    return rank[:n]


def _again(*keys: np.ndarray) -> np.ndarray:
    """Which places have keys that another place has too."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _joined(batch: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of some entries (doc, tk, first, count, n, phrase) one after the other, where each starts, and its strings."""
    data = np.frombuffer(b"".join(x[5] for x in batch), np.uint8)
    sizes = np.array([len(x[5]) for x in batch], np.int64)
    return data, np.cumsum(sizes) - sizes, np.array([x[3] for x in batch], np.int64)


def _starts(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every string of some phrases."""
    phrase = np.repeat(np.arange(len(first)), count)
    return phrase, first[phrase] + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)


def _laid(batch: list[tuple], length: int) -> tuple:
    """The strings of some entries: entry's number, place in it, and both hashes."""
    data, first, count = _joined(batch)
    phrase, start = _starts(first, count)
    s1, s2 = (x.of(start, start + length) for x in (Rolling(data, 0), PrimeRolling(data)))
    return phrase, start - first[phrase], s1, s2


def _distinct(s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct string, and whether it is there more than once."""
    order = np.lexsort((s2, s1))
    new = np.ones(len(order), bool)
    new[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff([*first, len(order)]) > 1


def _runs(batch: list[tuple], phrase: np.ndarray, at: np.ndarray, twice: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """(doc, tk, start, end) of what repeats among the strings of the entries, in entries of one occurrence."""
    out = []
    single = np.array([x[4] == 1 for x in batch])
    hits = np.flatnonzero(twice & single[phrase])
    if len(hits):
        breaks = np.flatnonzero((np.diff(phrase[hits]) != 0) | (np.diff(at[hits]) != 1)) + 1
        for run in np.split(hits, breaks):
            doc, tk, first = batch[phrase[run[0]]][:3]
            out.append((doc, tk, first + int(at[run[0]]), first + int(at[run[-1]]) + length))
    return out


def _resolved(batch: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """What repeats among the strings of the entries, by their suffix array."""
    data, first, count = _joined(batch)
    phrase, start = _starts(first, count)
    return _runs(batch, phrase, start - first[phrase], _again(suffix_ranks(data, length)[start]), length)


def repeats(docs: DataFrame, text: str, doc: str, length: int) -> DataFrame:
    """(doc, tk, start, end): bytes of documents that repeat, as runs not yet merged."""
    all_ = common.materialise(parsed(docs, text, doc, length), "phrases")
    slot = F.pmod(F.xxhash64("doc", "first"), F.lit(SLOTS)).cast("int")
    shared_triggers = _slotted(all_.select("t", F.lit(1).alias("n"), slot.alias("slot")), "t")
    shared = all_.withColumn("slot", slot).join(shared_triggers.select("t", "slot"), ["t", "slot"], "left_semi")
    shared = common.materialise(shared.drop("slot"), "shared-phrases")
    common.discard(all_)
    # The dictionary: distinct phrases with a trigger that others have.
    entry = F.struct("doc", "tk", "first", "count")
    entries = shared.groupBy("t", "p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("at"))
    entries = common.materialise(entries, "dictionary")
    part = F.pmod(F.col("p1"), F.lit(SLOTS)).cast("int")
    several = _slotted(entries.select("t", F.lit(1).alias("n"), part.alias("slot")), "t")
    mixed = entries.withColumn("slot", part).join(several, ["t", "slot"])
    # Triggers that many phrases share are resolved through a shuffle of all their strings, the others side by side.
    wanted = mixed.select("at.doc", "at.tk", F.struct("t", F.col("at.first").alias("first"), F.col("at.count").alias("count"), F.when(F.col("total") > TOGETHER, -F.col("n")).otherwise(F.col("n")).alias("n")).alias("x"))
    wanted = common.materialise(wanted.groupBy("doc", "tk").agg(F.collect_list("x").alias("list")), "wanted")
    common.discard(entries)
    read = common.materialise(read_phrases(docs, wanted, text, doc, length), "read-phrases")
    common.discard(wanted)

    def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tk", "start", "end"]
        held: list[tuple] = []
        last = None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*_resolved(held, length))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != last and len(held) >= 2000:
                    yield emit()
                    held = []
                held.append(tuple(row))
                last = t
        if held:
            yield emit()

    def every_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of a batch: what repeats within it is resolved at once, as runs (end set); of each distinct string one row goes on, with n = 2 if it is known to repeat."""
        names = ["doc", "tk", "start", "end", "n", "s1", "s2"]
        nothing = pa.nulls
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for k in range(0, len(rows), 2000):
                part = [x[1:] for x in rows[k : k + 2000]]
                phrase, at, s1, s2 = _laid(part, length)
                first, again = _distinct(s1, s2)
                of = lambda i: np.array([x[i] for x in part], np.int64)[phrase[first]]  # noqa: E731, B023
                n = np.where(again, 2, of(4))
                yield pa.RecordBatch.from_arrays([pa.array(of(0)), pa.array(of(1)), pa.array(of(2) + at[first]), nothing(len(first), pa.int64()), pa.array(n), _signed(s1[first]), _signed(s2[first])], names)
                runs = list(zip(*_runs(part, phrase, at, _again(s2, s1), length))) or [()] * 4
                m = len(runs[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in runs), nothing(m, pa.int64()), nothing(m, pa.int64()), nothing(m, pa.int64())], names)

    few = read.where("n > 0").repartition(common.partitions(docs.sparkSession), "t").sortWithinPartitions("t")
    few = few.mapInArrow(side_by_side, "doc long, tk long, start long, end long")
    many = read.where("n < 0").withColumn("n", -F.col("n")).repartition(common.partitions(docs.sparkSession)).sortWithinPartitions("t").mapInArrow(every_string, "doc long, tk long, start long, end long, n long, s1 long, s2 long")
    many = common.materialise(many, "strings")
    nearby, many = many.where("end is not null").select("doc", "tk", "start", "end"), many.where("end is null").drop("end")
    spot = F.pmod(F.xxhash64("doc", "start"), F.lit(SLOTS)).cast("int")
    twice = _slotted(many.select("s1", "s2", F.lit(1).alias("n"), spot.alias("slot")), "s1", "s2")
    alike = many.where("n = 1").withColumn("slot", spot).join(twice.select("s1", "s2", "slot"), ["s1", "s2", "slot"], "left_semi")
    alike = alike.select("doc", "tk", "start", (F.col("start") + length).alias("end"))
    # All occurrences of phrases that occur twice or more.
    slots = _slotted(shared.select("p1", "p2", F.lit(1).alias("n"), slot.alias("slot")), "p1", "p2")
    whole = shared.withColumn("slot", slot).join(slots.select("p1", "p2", "slot"), ["p1", "p2", "slot"], "left_semi")
    whole = whole.select("doc", "tk", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + length).alias("end"))
    return whole.unionByName(few).unionByName(nearby).unionByName(alike)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, text: str = "text", doc: str = "doc_id", length: int = 200) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept: binary) of each row."""
    runs = repeats(docs, text, doc, length)
    lists = common.materialise(runs.groupBy("doc", "tk").agg(F.collect_list(F.struct("start", "end")).alias("list")), "runs")
    common.release(docs.sparkSession)
    joined = _wanted(docs, lists, text, doc, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = batch.column(3)
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                t, spans = t or b"", []
                if lists[i].is_valid:
                    a, b = (x.to_pylist() for x in lists[i].values.flatten())
                    spans = merged(list(zip(a, b)))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(t[at:a])
                    at = b
                kept.append(t[at:])
                out.append((len(t), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")


def corpus_order(texts: list[bytes], window: int = 10, modulus: int = 11) -> list[int]:
    """The suffix array of the texts, each ended by a byte 1, concatenated. Texts mustn't hold bytes 0 or 1.

    A place where the hash of `window` bytes is 0 modulo `modulus` ends a phrase, and the next one starts with those
    bytes, so no phrase's suffix longer than the window is another phrase's prefix. Suffixes of the corpus are ordered
    by the suffix of the phrase they start in, and among equal ones by the order of the parse from the next phrase on.
    """
    corpus = b"\1".join(texts) + b"\1" if texts else b""
    if not corpus:
        return []
    padded = corpus + b"\0" * window
    starts = [0]
    for i in range(1, len(corpus)):
        if xxhash.xxh3_64_intdigest(padded[i : i + window]) % modulus == 0:
            starts.append(i)
    ends = [s + window for s in starts[1:]] + [len(padded)]
    found = [padded[a:b] for a, b in zip(starts, ends)]
    rank = {p: i for i, p in enumerate(sorted(set(found)))}
    parse = [rank[p] for p in found]
    # The parse's suffix array, by doubling.
    order = parse[:]
    k, n = 1, len(parse)
    while k < n:
        keys = [(order[i], order[i + k] if i + k < n else -1) for i in range(n)]
        ranks = {key: i for i, key in enumerate(sorted(set(keys)))}
        order = [ranks[key] for key in keys]
        k *= 2
    occurrences: dict[int, list[int]] = {}
    for i, p in enumerate(parse):
        occurrences.setdefault(p, []).append(i)
    groups: dict[bytes, list[tuple[int, int]]] = {}
    for p, r in rank.items():
        for s in range(len(p) - window):
            groups.setdefault(p[s:], []).append((r, s))
    out = []
    for suffix in sorted(groups):
        places = [(order[i + 1] if i + 1 < n else -1, starts[i] + s) for r, s in groups[suffix] for i in occurrences[r]]
        out += [place for _, place in sorted(places)]
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
