"""Document fingerprints: randomised edit embedding, bit-sampled banding and verification.

All texts take the same random walk: at step j a reader at character c stays or moves on by a shared random bit of
(j mod PERIOD, c); what it reads is the embedding. Two texts a few edits apart fall into step again after each edit, so
their edit distance becomes a Hamming distance of embeddings. A fingerprint has the embedding's length and SAMPLES bytes
read at steps that a seeded reservoir keeps of that many steps: for a longer embedding the same ones, but where a later step took a place.
So texts of different lengths still share the steps that both reach, and the likeness of two fingerprints is the share of the longer
one's steps at which both read the same.

Links: distinct fingerprints are banded by their sampled bytes; all that agree in a band are held against each other, in
blocks of bounded size, and links are verified by likeness. A link of likeness 0.8 agrees in some band with probability
0.998. `links` counts them for each fingerprint, so a large group of near copies costs no row a pair; `similar` gives the pairs.

Walks of a batch run side by side, a step for all of them at a time. Whole texts are walked.

Defined results: a null text is an empty one; an empty text's samples are all blank, and its likeness is 1 to an empty text and 0 to any other;
equal texts have equal fingerprints; rows with equal ids follow each other by a hash of their texts, null ids after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PERIOD = 256
CLASSES = 256
SAMPLES = 128
#: Sampled bytes of a band; so many bands as fit.
WIDTH = 6
#: A text is walked together with others of its batch while this many are left; the rest go alone.
TOGETHER = 6
#: Characters walked together at most, unless one text alone has more.
BLOCK = 1 << 22
#: Fingerprints of a block of those that agree in a band.
BLOCK_PRINTS = 400


def _walk_tables() -> tuple[np.ndarray, list[bytes]]:
    """next_state[c * PERIOD + s]: the step (mod PERIOD) after a reader at character class c, at step s, has moved on."""
    bits = np.random.default_rng(20240229).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, 0] = 1
    steps = np.arange(2 * PERIOD)
    twice = np.concatenate([bits, bits], axis=1)
    at = np.where(twice == 1, steps, 4 * PERIOD)
    following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    table = ((following + 1) % PERIOD).astype(np.uint8)
    return table.ravel(), [row.tobytes() for row in table]


_TABLE, _ROWS = _walk_tables()


def _reservoir(most: int = 1 << 44) -> tuple[np.ndarray, np.ndarray]:
    """Steps beyond the first SAMPLES that a reservoir of SAMPLES takes in, and the place of each."""
    rng = np.random.default_rng(31337)
    steps, slots, t, w = [], [], SAMPLES - 1, float(np.exp(np.log(rng.random()) / SAMPLES))
    while True:
        t += int(np.floor(np.log(rng.random()) / np.log1p(-w))) + 1
        if t >= most:
            return np.array(steps, np.int64), np.array(slots, np.int64)
        steps.append(t)
        slots.append(int(rng.integers(SAMPLES)))
        w *= float(np.exp(np.log(rng.random()) / SAMPLES))


_TAKEN, _PLACES = _reservoir()


def sampled(length: int) -> np.ndarray:
    """The step in each place after so many steps; places not filled hold steps that aren't reached."""
    steps, n = np.arange(SAMPLES), int(np.searchsorted(_TAKEN, length))
    steps[_PLACES[:n]] = _TAKEN[:n]
    return steps


def classes(text: str) -> np.ndarray:
    """A class in 0..255 of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _walk(texts: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text the state before each character and after the last; starts: the first states."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    states = [np.empty(n + 1, np.uint8) for n in sizes]
    flat = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, np.uint8)
    begin = np.cumsum(sizes[order]) - sizes[order]
    out = np.empty(len(flat), np.uint8)
    now = np.array([starts[i] for i in order], np.uint8)
    for k, i in enumerate(order):
        states[i][0] = starts[i]
    ordered = sizes[order]
    step, active = 0, int((ordered > 0).sum())
    while active >= TOGETHER:
        # All of the first `active` texts have a character at this step, up to the shortest of them.
        last = int(ordered[active - 1])
        base = begin[:active]
        s = now[:active].astype(np.int64)
        for j in range(step, last):
            s = _TABLE[flat[base + j].astype(np.int64) << 8 | s].astype(np.int64)
            out[base + j] = s
        now[:active] = s
        step = max(step, last)
        active = int((ordered > step).sum())
    for k in range(active):
        s, rows = int(now[k]), _ROWS
        rest = bytearray()
        for c in flat[begin[k] + step : begin[k] + ordered[k]].tobytes():
            s = rows[c][s]
            rest.append(s)
        out[begin[k] + step : begin[k] + ordered[k]] = np.frombuffer(bytes(rest), np.uint8)
    for k, i in enumerate(order):
        states[i][1:] = out[begin[k] : begin[k] + ordered[k]]
    return states


def _samples(text: np.ndarray, states: np.ndarray) -> bytes:
    """The fingerprint: eight bytes of embedding length, then what is read at the sampled steps (0 where the text has ended)."""
    if not len(text):
        return bytes(8 + SAMPLES)
    spent = (states[1:].astype(np.int16) - states[:-1].astype(np.int16) - 1) % PERIOD + 1
    end = np.cumsum(spent, dtype=np.int64)
    length = int(end[-1])
    at = np.searchsorted(end, sampled(length), "right")
    read = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], 0).astype(np.uint8)
    return length.to_bytes(8, "big") + read.tobytes()


def fingerprints(texts: list[str]) -> list[bytes]:
    out: list[bytes] = []
    for group in _blocks(texts):
        own = [classes(t) for t in group]
        out += [_samples(c, s) for c, s in zip(own, _walk(own, [0] * len(own)))]
    return out


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > BLOCK:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def likeness(a: bytes, b: bytes) -> float:
    """Share of the longer embedding's sampled steps that the shorter one reaches and where both read the same."""
    short, long = sorted((int.from_bytes(a[:8], "big"), int.from_bytes(b[:8], "big")))
    if not long:
        return 1.0
    steps = sampled(long)
    same = np.frombuffer(a[8:], np.uint8) == np.frombuffer(b[8:], np.uint8)
    return float((same & (steps < short)).sum() / (steps < long).sum())


def packed(rows: DataFrame) -> DataFrame:
    """(doc, text_key, packed) of rows (doc, text): the text's length in bytes and its compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t).to_bytes(8, "big") + codec.compress(t, asbytes=True) if t else b"" for t in texts], pa.binary())], ["doc", "text_key", "packed"])

    return rows.select("doc", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc long, text_key long, packed binary")


def successors(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """(bucket, guest, doc, text_key, packed), to be read in order of bucket, guest, doc descending, text_key: rows in ranges of doc, and after each range the first row of the next one as guest. Texts are packed, as they are shuffled.

    Ranges are split at quantiles. An id that fills a whole range, and null, which comes last, have ranges by the text's hash
    of their own. The first rows of ranges, as ids and hashes (a few for each partition), go to the driver.
    """
    spark = docs.sparkSession
    rows = packed(docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    n = 4 * common.partitions(spark)
    quantiles = docs.select(F.percentile_approx(F.col(doc).cast("long"), [i / n for i in range(1, n)], 100_000)).first()[0] or []
    splits = sorted(set(quantiles), reverse=True)
    heavy = [s for s in splits if quantiles.count(s) > 1]
    place = F.size(F.filter(F.array(*(F.lit(s) for s in splits)), lambda s: s > F.col("doc"))) if splits else F.lit(0)
    place = F.when(F.col("doc").isNull(), F.lit(len(splits) + 1)).otherwise(place)
    # A range's least id is its split, so what is dealt by hash comes after the rest of its range.
    by_hash = 1 + (F.shiftrightunsigned(F.col("text_key").bitwiseXOR(F.lit(-(1 << 63))), 32) * n / F.lit(float(1 << 32))).cast("int")
    dealt = F.col("doc").isNull() | (F.col("doc").isin(heavy) if heavy else F.lit(False))
    bucket = (place * (n + 2) + F.when(dealt, by_hash).otherwise(0)).cast("int").alias("bucket")
    placed = rows.select(bucket, "doc", "text_key", "packed")
    name = F.struct(F.bitwise_not(F.col("doc")).alias("below"), "text_key")
    keys = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    firsts = keys.select(bucket, "doc", "text_key").groupBy("bucket").agg(F.min(name).alias("first")).orderBy("bucket").collect()
    if not firsts:
        return placed.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "doc", "text_key", "packed")
    # The range before each range; the first row of all follows the last range.
    before = F.array(*(F.struct(F.lit(r["first"]["below"]).cast("long").alias("below"), F.lit(r["first"]["text_key"]).alias("text_key"), F.lit(firsts[i - 1]["bucket"]).alias("b")) for i, r in enumerate(firsts)))
    guest = F.get(F.filter(before, lambda x: (x["text_key"] == F.col("text_key")) & x["below"].eqNullSafe(F.bitwise_not(F.col("doc")))), F.lit(0))["b"]
    homes = F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(guest.alias("b"), F.lit(True).alias("guest"))), lambda x: x["b"].isNotNull())
    return placed.select(F.explode(homes).alias("home"), "doc", "text_key", "packed").select(F.col("home.b").alias("bucket"), F.col("home.guest").alias("guest"), "doc", "text_key", "packed")


def edited_pairs(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text's walk starts where the two texts part, from the state of the first.
    """
    return _hexed(_edited(docs, text, doc))


def _hexed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _edited(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """edited_pairs() with hashes and fingerprints in binary."""
    rows = successors(docs, text, doc)
    placed = rows.repartition(common.partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc"), "text_key").drop("text_key")

    def finish(own: list[tuple], following: list[tuple]) -> list[tuple]:
        """own: (doc, text); following: the next text of each."""
        texts = [t for _, t in own]
        chars = [classes(t) for t in texts]
        states = _walk(chars, [0] * len(texts))
        prints = [_samples(c, s) for c, s in zip(chars, states)]
        cut = [len(t) - len(t) // 3 for t in texts]
        tails = [n[: len(t) // 3] for t, n in zip(texts, following)]
        tail_chars = [classes(t) for t in tails]
        tail_states = _walk(tail_chars, [int(s[k]) for s, k in zip(states, cut)])
        out = []
        for (d, t), c, s, k, tail, tc, ts, p in zip(own, chars, states, cut, tails, tail_chars, tail_states, prints):
            edited = _samples(np.concatenate([c[:k], tc]), np.concatenate([s[:k], ts]))
            sha = hashlib.sha256((t[:k] + tail).encode("utf-8", "surrogatepass")).digest()
            out.append((d, len(t), sha, p, edited))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        codec = pa.Codec("zstd")
        held: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (bucket, guest, doc, text) in order; each row that isn't a guest is followed by its next one."""
            at = [i for i in range(len(rows) - 1) if not rows[i][1]]
            # A next row's own fingerprint is needed too; those that are no owners here are walked for it alone.
            done = {i: r for i, r in zip(at, finish([rows[i][2:] for i in at], [rows[i + 1][3] for i in at]))}
            others = [i + 1 for i in at if i + 1 not in done]
            prints = {i: r[3] for i, r in done.items()} | dict(zip(others, fingerprints([rows[i][3] for i in others])))
            out = [(*done[i], likeness(done[i][3], done[i][4]), likeness(done[i][3], prints[i + 1])) for i in at]
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        size = 0
        for batch in batches:
            for *row, packed_ in zip(*(c.to_pylist() for c in batch.columns)):
                row = (*row, codec.decompress(packed_[8:], int.from_bytes(packed_[:8], "big"), asbytes=True).decode("utf-8", "replace") if packed_ else "")
                if held and held[-1][0] != row[0]:
                    yield emit(held)
                    held, size = [], 0
                elif size > BLOCK and not row[1]:
                    yield emit([*held, row])
                    held, size = [], 0
                if not (row[1] and held and held[-1][1]):
                    held.append(row)
                    size += len(row[3])
        if held:
            yield emit(held)

    return placed.mapInArrow(run, "doc long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def linked(prints: list[bytes], second: list[bool], band: int, width: int, within: bool, least: float) -> list[tuple[int, int, float]]:
    """(i, j, likeness) of pairs of distinct prints, i the greater, that have at least this likeness and first agree in this band. within: one block against itself, else first against second side."""
    lengths = np.array([int.from_bytes(p[:8], "big") for p in prints], np.int64)
    read = np.array([np.frombuffer(p[8:], np.uint8) for p in prints])
    steps = np.array([sampled(n) for n in lengths.tolist()])
    places = (steps < lengths[:, None]).sum(1)
    side = np.array(second)
    order = np.argsort(np.argsort(np.array(prints, object), kind="stable"), kind="stable")
    out = []
    for i in range(len(prints)):
        others = np.flatnonzero((order < order[i]) & (within | (side != side[i])))
        if not len(others):
            continue
        same = read[others] == read[i]
        # The greater print is the longer one, as prints start with their lengths.
        found = (same & (steps[i] < lengths[others, None])).sum(1) / places[i]
        before = (same[:, : band * width].reshape(len(others), band, width).all(2) & (read[i, : band * width].reshape(band, width) != 0).any(1)).any(1)
        out += [(i, int(j), float(x)) for j, x in zip(others[~before], found[~before]) if x >= least]
    return out


def _units(distinct: DataFrame) -> DataFrame:
    """(number, fingerprint, key, band, i, j, second), sorted by unit: distinct fingerprints (number, fingerprint) that agree in a band are cut into blocks, and each pair of blocks is a unit of work."""
    band = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES // WIDTH - 1)), lambda b: F.struct(b.alias("band"), F.substring("fingerprint", b * WIDTH + 9, F.lit(WIDTH)).alias("read")))
    rows = distinct.select("number", F.explode(band).alias("x")).where(F.col("x.read") != F.lit(bytes(WIDTH)))
    rows = rows.select("number", F.col("x.band").alias("band"), F.xxhash64("x.band", "x.read").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK_PRINTS).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("number", F.lit(29)), F.col("blocks")).cast("int"))
    rows = rows.select("number", "band", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = rows.select("number", "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))
    whole = units.join(distinct, "number").select("number", "fingerprint", "key", "band", "i", "j", "second")
    return whole.repartition(common.partitions(distinct.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _verified(units: DataFrame, least: float, give, schema: str) -> DataFrame:
    """give(members of a unit as (number, fingerprint in binary), its links as places (i, j) and likeness) for each unit; columns by the schema."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, second = None, [], []
        fields = [f.split() for f in schema.split(", ")]
        kinds = {"binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}

        def emit() -> pa.RecordBatch:
            found = linked([p for _, p in held], second, unit[3], WIDTH, unit[1] == unit[2], least)
            columns = list(zip(*give(held, found))) or [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])

        for batch in batches:
            for number, fingerprint, key, band, i, j, side in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != (key, i, j, band):
                    if len(held) > 1:
                        yield emit()
                    unit, held, second = (key, i, j, band), [], []
                held.append((number, fingerprint))
                second.append(side)
        if len(held) > 1:
            yield emit()

    return units.mapInArrow(verify, schema)


def _distinct(prints: DataFrame) -> DataFrame:
    own = prints.select("fingerprint").where("fingerprint is not null").distinct()
    return common.materialise(own.withColumn("number", F.monotonically_increasing_id()), "fingerprints", drop_shuffles=True)


def links(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint, n_links) of fingerprints with links: other distinct fingerprints of at least this likeness. prints: a column fingerprint (hex)."""
    return _links(prints.select(F.unhex("fingerprint").alias("fingerprint")), least).withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def _links(prints: DataFrame, least: float = 0.8) -> DataFrame:
    distinct = _distinct(prints)

    def give(held: list[tuple[int, str]], found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
        counts: dict[int, int] = {}
        for i, j, _ in found:
            for k in (i, j):
                counts[held[k][0]] = counts.get(held[k][0], 0) + 1
        return list(counts.items())

    totals = _verified(_units(distinct), least, give, "number long, n long").groupBy("number").agg(F.sum("n").alias("n_links"))
    return totals.join(distinct, "number").select("fingerprint", "n_links")


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint_a, fingerprint_b, likeness) of linked distinct fingerprints, each pair once. prints: a column fingerprint (hex)."""
    give = lambda held, found: [(held[i][1], held[j][1], x) for i, j, x in found]
    binary = prints.select(F.unhex("fingerprint").alias("fingerprint"))
    pairs = _verified(_units(_distinct(binary)), least, give, "fingerprint_a binary, fingerprint_b binary, likeness double")
    return pairs.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint_a", "fingerprint_b")})


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and of each fingerprint the number of others like it."""
    rows = common.materialise(_edited(common.table(spark, sf_dir, "documents"), "text", "doc_id").withColumnRenamed("doc", "doc_id"), "edited", drop_shuffles=True)
    counts = _links(rows)
    joined = rows.join(counts, "fingerprint", "left").select(*rows.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return _hexed(joined)
