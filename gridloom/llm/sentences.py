"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words where no piece can cross: before a space mark that follows another character, and around
characters that only single-character pieces hold. All substrings of a word up to the longest piece are exploded and
equi-joined to the piece table; a word's edges are grouped, each packed into a long, and folded with Spark's
higher-order aggregate. Words of every length go this way.

The fold depends on the model's kind. For a unigram model it is Viterbi: over the edges by their ends, the best score
of each end, then the path back from the last. A BPE model's ids are not those of the best sum of scores, so for it the
fold takes the edges in order of their merges: an edge becomes a piece if both its ends are still boundaries, which gives
the model's own ids. Boundaries are bits of an array of longs.

Words are counted over the whole corpus. The most frequent ones, of up to LONGEST characters, get their ids
once. Other words are cut into segments between neighbouring characters that no piece holds; the most frequent of them, at most `most`, are folded
once too, so the tables that every task gets are bounded. What remains is folded for each document that has it,
where the document will be put together: each document goes there once, as the ids known so far, compressed, with its
other segments beside them. No table has to hold all words of a corpus.

Defined results: null and empty texts have no ids; characters without a piece become byte pieces (the unknown id in a
model that has none); each row is encoded by itself, repeated rows alike (rows equal in id and text are put together in one
task); an empty table gives an empty result. Decoding joins pieces, bytes as UTF-8, and drops the first space mark.
"""

from __future__ import annotations

import os
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Characters of a word that the table of frequent words holds at most.
LONGEST = 64
#: Frequent segments at most; frequent words are a fifth as many.
MOST = 450_000
#: Bytes of texts whose words are handled together.
TOGETHER = 1 << 21
#: Bits of a packed edge: rank of its piece, length, and start or end.
_RANK, _LENGTH = 20, 7
#: The rank of a character without a piece.
_NONE = (1 << _RANK) - 1


@dataclass
class Pieces:
    """The table of a model: (piece, id, score) of ordinary pieces, the ids of bytes, and where texts may be cut."""

    rows: list[tuple[str, int, float]]
    bytes_: list[int]
    unknown: int
    alone: str
    unigram: bool

    @property
    def width(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)

    @property
    def spells(self) -> bool:
        """Whether the model has a piece for each byte."""
        return len(set(self.bytes_)) == 256


def load(model: str) -> Pieces:
    """model: name of a public tokenizer's file, or a path to one."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model if os.path.sep in model else public_tokenizers.path(model))
    n = sp.vocab_size()
    rows = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    together = {c for p, _, _ in rows if len(p) > 1 for c in p}
    alone = "".join(c for c in "\n\t\r" if c not in together)
    # BPE scores are the negated order of merges; a unigram model's are log-probabilities, not whole numbers.
    unigram = any(s != int(s) for _, _, s in rows)
    return Pieces(rows, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.unk_id(), alone, unigram)


class Cutter:
    """The words of a text, spaces in place of space marks. A word after a single space stands as it is; any other comes behind a NUL: the first of a line, several spaces and what follows them, a character that stands alone."""

    def __init__(self, pieces: Pieces):
        import re

        self.alone = pieces.alone
        self.odd = re.compile(f"  |[\0{self.alone}]").search
        alone = re.escape(self.alone)
        self.find = re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else "")).findall

    def __call__(self, text: str) -> list[str]:
        text = " " + text.replace(MARK, " ")
        if "\n" not in self.alone:
            return ["\0" + w for w in self.find(text)]
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\0\n")
            if self.odd(line):
                out += ["\0" + w for w in self.find(line)]
            else:
                first, *more = line.split(" ")
                if first:
                    out.append("\0" + first)
                out += more
        return out


    def many(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(offsets, words) of texts that aren't null: the words of text k are those from offsets[k] to offsets[k + 1]. Texts of single spaces and lines are split as columns, others one by one; an empty line leaves the word NUL, which has no ids."""
        odd = pc.match_substring_regex(texts, f"^$|^ |  |[\\x00\\t\\r{MARK}]" if "\n" in self.alone else "").to_numpy(zero_copy_only=False)
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \0\n \0"), " ")
        lists = [self(t) if t else [] for t in texts.take(pa.array(other)).to_pylist()]
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = np.diff(split.offsets.to_numpy())
        sizes[other] = [len(x) for x in lists]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words = split.flatten()
        if len(other):
            # Both parts in order of texts.
            both = pa.concat_arrays([words, pa.array([w for x in lists for w in x], pa.string())])
            begin = np.empty(len(texts), np.int64)
            begin[plain] = split.offsets.to_numpy()[:-1]
            begin[other] = len(words) + np.cumsum(sizes[other]) - sizes[other]
            words = both.take(pa.array(spread(begin, sizes)))
        return offsets, words


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. of sizes[0] numbers, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(begin) or begin.max() < 1 << 31) else np.int64
    out = np.repeat((begin - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def listed(strings: pa.Array) -> list[str]:
    """What to_pylist() gives for strings without nulls, several times faster."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string or binary column that have at most so many bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total + n > most and k > start:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def spaced(word: str) -> str:
    """A word of a Cutter as it is in the text."""
    return word[1:] if word[:1] == "\0" else " " + word


class Segments:
    """Words cut between neighbouring characters that no piece has side by side."""

    def __init__(self, pieces: Pieces):
        pairs = {p[i : i + 2].replace(MARK, " ") for p, _, _ in pieces.rows for i in range(len(p) - 1)}
        self.number = {c: k for k, c in enumerate(sorted({c for p in pairs for c in p}), 1)}
        self.near = np.zeros(1 << 16, np.int64)
        for c, k in self.number.items():
            if ord(c) < 1 << 16:
                self.near[ord(c)] = k
        self.width = len(self.number) + 1
        self.pairs = np.array(sorted(self.number[p[0]] * self.width + self.number[p[1]] for p in pairs), np.int64)

    def many(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments of some words that aren't empty, and where each word's begin; all words are cut at once, as columns of characters."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = self.near[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points >= 0xFFFF).tolist():
            own[k] = self.number.get(text[k], 0)
        pair = own[:-1] * self.width + own[1:]
        at = np.searchsorted(self.pairs, pair)
        cut = np.ones(len(points), bool)
        if len(pair) and len(self.pairs):
            cut[1:] = self.pairs[np.minimum(at, len(self.pairs) - 1)] != pair
        starts = np.cumsum([0, *map(len, words)])[:-1]
        cut[starts] = True
        places = np.flatnonzero(cut)
        ends = places.tolist() + [len(points)]
        return [text[a:b] for a, b in zip(ends, ends[1:])], np.searchsorted(places, starts)

    def __call__(self, word: str) -> list[str]:
        return self.many([word])[0]


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer makes a single constant of."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Fold:
    """The lattice's edges packed into longs that sort in the order of the fold, and the fold."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.ranked = self.order(pieces)
        if len(self.ranked) >= _NONE or pieces.width >= 1 << _LENGTH:
            raise ValueError(f"at most {_NONE} pieces of under {1 << _LENGTH} characters")
        floor = min((r[2] for r in self.ranked), default=0.0) - 10.0
        self.score = lambda rank: F.coalesce(F.get(_constant([r[2] for r in self.ranked] or [0.0], "double"), rank), F.lit(floor))

    @staticmethod
    def order(pieces: Pieces) -> list[tuple[str, int, float]]:
        """Pieces by rank. A BPE model's scores are the order of its merges, each its own."""
        return sorted(pieces.rows, key=lambda r: (-r[2], r[1]))

    def packed(self, rank: Column, s: Column, e: Column) -> Column:
        rank, s, e = (x.cast("long") for x in (rank, s, e))
        if self.pieces.unigram:
            return F.shiftleft(e, _RANK + _LENGTH) + F.shiftleft(e - s, _RANK) + rank
        return F.shiftleft(rank, 63 - _RANK) + F.shiftleft(s, _LENGTH) + (e - s)

    def unpacked(self, x: Column) -> tuple[Column, Column, Column]:
        """(rank, s, e)"""
        low = lambda y, bits: y.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        if self.pieces.unigram:
            e = F.shiftright(x, _RANK + _LENGTH)
            return low(x, _RANK).cast("int"), (e - low(F.shiftright(x, _RANK), _LENGTH)).cast("int"), e.cast("int")
        s = low(F.shiftright(x, _LENGTH), 63 - _RANK - _LENGTH)
        return F.shiftright(x, 63 - _RANK).cast("int"), s.cast("int"), (s + low(x, _LENGTH)).cast("int")

    def edges(self, words: DataFrame, *key: str) -> DataFrame:
        """(key, edge): all substrings of column word that are pieces of two characters or more; for a unigram model every single character too, a piece or not."""
        spark = words.sparkSession
        # The table has as many rows as the vocabulary, whatever the corpus.
        table = spark.createDataFrame([(p.replace(MARK, " "), k) for k, (p, _, _) in enumerate(self.ranked)], "piece string, rank int")
        # Joined on a hash, as tables by a long are several times faster than by a string; that the strings are equal is said in a way that doesn't make them keys too.
        table = F.broadcast(table.select(F.xxhash64("piece").alias("hash"), "piece", "rank"))
        same = lambda found: (found["hash"] == table["hash"]) & F.startswith(found["part"], table["piece"]) & (F.octet_length(found["part"]) <= F.octet_length(table["piece"]))
        least = 1 if self.pieces.unigram else 2
        at = words.where(F.char_length("word") >= least).select(*key, "word", F.explode(F.sequence(F.lit(0), F.char_length("word") - least)).alias("s"))
        reach = F.sequence(F.lit(least), F.least(F.lit(self.pieces.width), F.char_length("word") - F.col("s")))
        at = at.select(*key, "s", F.substring("word", F.col("s") + 1, F.lit(self.pieces.width)).alias("rest"), F.explode(reach).alias("l"))
        found = at.withColumn("part", F.substring("rest", F.lit(1), F.col("l"))).withColumn("hash", F.xxhash64("part"))
        found = found.join(table, same(found), "left").where("rank is not null or l = 1") if self.pieces.unigram else found.join(table, same(found))
        return found.select(*key, self.packed(F.coalesce("rank", F.lit(_NONE)), F.col("s"), F.col("s") + F.col("l")).alias("edge"))

    def folded(self, words: DataFrame, *key: str) -> DataFrame:
        """(key, path): the edges of each key's word that become pieces, in order, each as its start and rank in a long. Characters that no edge covers are by themselves; a word without edges has no row."""
        _, _, e = self.unpacked(F.col("edge"))
        grouped = self.edges(words, *key).groupBy(*key).agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.max(e).alias("n"))
        path = self.viterbi(F.col("edges"), F.col("n")) if self.pieces.unigram else self.merged(F.col("edges"), F.col("n"))
        return grouped.select(*key, path.alias("path"))

    def placed(self, x: Column) -> Column:
        rank, s, _ = self.unpacked(x)
        return F.shiftleft(s.cast("long"), _RANK) + rank

    def merged(self, edges: Column, n: Column) -> Column:
        """Each edge in order joins what lies between its ends if both are boundaries; what then are neighbouring boundaries are the pieces. Edges may be given more than once (those of repeated rows)."""
        def between(s: Column, e: Column, i: Column) -> Column:
            """The bits of the i-th long that lie between two boundaries."""
            bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(F.lit(32), k - 32 * i)))
            return bit(e) - bit(s + 1)

        def free(mask: Column, k: Column) -> Column:
            return F.getbit(F.get(mask, F.shiftright(k, 5)), k.bitwiseAND(F.lit(31))) == 1

        def step(mask: Column, x: Column) -> Column:
            _, s, e = self.unpacked(x)
            joined = F.transform(mask, lambda v, i: v.bitwiseAND(F.bitwise_not(between(s, e, i))))
            return F.when(free(mask, s) & free(mask, e), joined).otherwise(mask)

        start = F.transform(F.sequence(F.lit(0), F.shiftright(n, 5)), lambda _: F.lit((1 << 32) - 1).cast("long"))

        def remains(mask: Column, x: Column) -> Column:
            _, s, e = self.unpacked(x)
            return free(mask, s) & free(mask, e) & F.forall(F.transform(mask, lambda v, i: v.bitwiseAND(between(s, e, i))), lambda v: v == 0)

        mask = F.aggregate(edges, start, step)
        return common.let(mask, lambda m: F.sort_array(F.array_distinct(F.transform(F.filter(edges, lambda x: remains(m, x)), self.placed))))

    def viterbi(self, edges: Column, n: Column) -> Column:
        """The best path's edges: for each end its best score and packed edge, then back from the last end."""
        first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("edge")))

        def step(best: Column, x: Column) -> Column:
            rank, s, e = self.unpacked(x)
            own = F.struct((F.get(best, s)["score"] + self.score(rank)).alias("score"), x.alias("edge"))
            # Ends come in order, and each has at least its last character's edge.
            return common.let(own, lambda o: F.when(e == F.size(best), F.concat(best, F.array(o))).when(o["score"] > F.get(best, e)["score"], F.concat(F.slice(best, F.lit(1), e), F.array(o))).otherwise(best))

        def walk(best: Column) -> Column:
            def go(path: Column, _: Column) -> Column:
                end = F.when(F.size(path) == 0, n).otherwise(self.unpacked(F.element_at(path, -1))[1])
                return F.when(end > 0, F.concat(path, F.array(F.get(best, end)["edge"]))).otherwise(path)

            back = F.aggregate(F.sequence(F.lit(1), n), F.array().cast("array<long>"), go)
            return F.transform(F.reverse(back), self.placed)

        return common.let(F.aggregate(edges, first, step), walk)


class Speller:
    """Ids of a word and the path of its edges."""

    def __init__(self, pieces: Pieces):
        ranked = Fold.order(pieces)
        self.ids, self.lengths = [r[1] for r in ranked], [len(r[0]) for r in ranked]
        self.single = {p.replace(MARK, " "): [i] for p, i, _ in pieces.rows if len(p) == 1}
        self.pieces = pieces

    def alone(self, c: str) -> list[int]:
        """A character by itself: its piece, else its bytes' pieces, else the unknown one."""
        own = self.single.get(c)
        return own if own is not None else [self.pieces.bytes_[b] for b in c.encode("utf-8", "replace")] if self.pieces.spells else [self.pieces.unknown]

    def __call__(self, word: str, path: list[int] | None) -> list[int]:
        out: list[int] = []
        at = 0
        for x in path or ():
            s, rank = x >> _RANK, x & _NONE
            for c in word[at:s]:
                out += self.alone(c)
            if rank == _NONE:
                out += self.alone(word[s])
                at = s + 1
            else:
                out.append(self.ids[rank])
                at = s + self.lengths[rank]
        for c in word[at:]:
            out += self.alone(c)
        return out


def dictionary(words: DataFrame, pieces: Pieces) -> dict[str, list[int]]:
    """Ids of distinct words that aren't empty (spaces for space marks). For tables of bounded size."""
    words = words.select("word")
    found = words.join(Fold(pieces).folded(words, "word"), "word", "left").toArrow()
    spell, out = Speller(pieces), {}
    for batch in found.to_batches():
        path = batch.column(1)
        ends, values = path.offsets.to_numpy().tolist(), path.values.to_numpy().tolist()
        for w, a, b in zip(listed(batch.column(0)), ends, ends[1:]):
            out[w] = spell(w, values[a:b])
    return out


def counted(docs: DataFrame, text: str, pieces: Pieces) -> DataFrame:
    """(word, n) of all words of a corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Cutter(pieces)
        for batch in batches:
            texts = batch.column(0).drop_null()
            for a, b in parts(texts, 8 * TOGETHER):
                found = pc.value_counts(words.many(texts.slice(a, b - a))[1])
                yield pa.RecordBatch.from_arrays(found.flatten(), ["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").where(F.col("word") != "\0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Words of up to LONGEST characters that occur at least so often that there are at most so many; the bar is found on a histogram of the counts' logarithms."""
    short = counts.where(F.char_length("word") <= LONGEST).withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    left, bar = most, None
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        bar = r["level"]
    return short.where(F.col("level") >= bar) if bar is not None else short.where("false")


class Table:
    """Codes of names, in a few columns instead of an object for each, as every worker holds one: names by their hashes, in order, with their codes one after the other. Of names with equal hashes one is kept; the others aren't known."""

    def __init__(self, names: list[str], codes: list[bytes], code: str):
        self.hashes, first = np.unique(self.hashed(names), return_index=True)
        order = first.tolist()
        self.names = pa.array([names[k] for k in order], pa.string())
        self.codes = np.frombuffer(b"".join([codes[k] for k in order]), code)
        self.ends = (np.cumsum([0, *(len(codes[k]) for k in order)]) // self.codes.itemsize).astype(np.int32 if len(self.codes) < 1 << 31 else np.int64)

    @staticmethod
    def hashed(names: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))

    def find(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each name is known, where its codes begin and how many there are (0 and 0 if it isn't)."""
        is_known, begin, sizes = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if len(names) and len(self.hashes):
            own = self.hashed(names)
            # In order, so that neighbouring searches read neighbouring places.
            order = np.argsort(own)
            own = own[order]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == own)
            order, at = order[hit], at[hit]
            same = pc.equal(self.names.take(pa.array(at)), pa.array(names, pa.string()).take(pa.array(order))).to_numpy(zero_copy_only=False)
            order, at = order[same], at[same]
            is_known[order], begin[order], sizes[order] = True, self.ends[at], self.ends[at + 1] - self.ends[at]
        return is_known, begin, sizes


class Known:
    """Ids, as bytes, of the frequent words (as a Cutter gives them) and of the frequent segments of others."""

    def __init__(self, counts: DataFrame, pieces: Pieces, most: int):
        words = frequent(counts, most // 5).select("word")
        cut = Segments(pieces)

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words_ = [spaced(w) for w in listed(batch.column(0))]
                own, first = cut.many(words_)
                n = np.repeat(batch.column(1).to_numpy(), np.diff([*first, len(own)]))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(n)], ["word", "n"])

        others = counts.join(words, "word", "left_anti").mapInArrow(segments, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        own = counts.join(words, "word", "left_semi").mapInArrow(segments, "word string, n long").select("word")
        chosen = frequent(common.materialise(others, "segments"), most).select("word", F.lit(True).alias("own"))
        parts = chosen.unionByName(own.select("word", F.lit(False).alias("own"))).groupBy("word").agg(F.max("own").alias("own"))
        parts = common.materialise(parts, "frequent-segments")
        code = code_type(pieces)
        ids = {w: array(code, x).tobytes() for w, x in dictionary(parts, pieces).items()}
        top = words.toArrow().column(0).to_pylist()
        found, first = cut.many([spaced(w) for w in top])
        ends = [*first.tolist(), len(found)]
        self.words = Table(top, [b"".join([ids[x] for x in found[a:b]]) for a, b in zip(ends, ends[1:])], code)
        names = parts.where("own").select("word").toArrow().column(0).to_pylist()
        self.segments = Table(names, [ids[w] for w in names], code)


def code_type(pieces: Pieces) -> str:
    """The array type of codes: two bytes hold an id and a mark where the vocabulary allows it, else four."""
    return "H" if max((i for _, i, _ in pieces.rows), default=0) < 0xFFFF and max(pieces.bytes_, default=0) < 0xFFFF else "I"


def byte_table(pieces: Pieces) -> dict[int, bytes]:
    """What each id stands for, in bytes; the unknown piece for nothing."""
    return {pieces.unknown: b""} | {i: p.replace(MARK, " ").encode() for p, i, _ in pieces.rows} | {i: bytes([b]) for b, i in enumerate(pieces.bytes_) if pieces.spells}


def many_decoder(pieces: Pieces):
    """A function from the ids of several texts, one after the other, and their numbers to the bytes that each stands for."""
    own = byte_table(pieces)
    row = [own.get(i, b"") for i in range(max(own) + 1)]
    sizes = np.array([len(x) for x in row], np.int64)
    begin, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(row), np.uint8)

    def decode(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        read = sizes[ids]
        flat = every[spread(begin[ids], read)].tobytes()
        ends = np.concatenate([[0], np.cumsum(read)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    return decode


def decoder(pieces: Pieces):
    """A function from ids to text."""
    table = byte_table(pieces)

    def decode(ids: list[int]) -> str:
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    return decode


def encode(docs: DataFrame, text: str = "text", doc: str = "doc_id", model: str = "piece_bpe_32k.model", most: int = MOST) -> DataFrame:
    """(doc, ids, round_trip) of each row. most: frequent segments at most whose ids every task gets; and a fifth as many frequent words."""
    spark = docs.sparkSession
    pieces = load(model)
    counts = common.materialise(counted(docs, text, pieces), "words")
    known = spark.sparkContext.broadcast(Known(counts, pieces, most))
    common.discard(counts)
    kind = docs.schema[doc].dataType.simpleString()
    code = code_type(pieces)
    hole = int(np.iinfo(code).max)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, other, body) of a row; body: its id (empty for null, else behind a byte), its codes, compressed, and its segments that aren't known. A hole in the codes is a mark and the place of a segment in two numbers of 15 bits."""
        words, cut, table = Cutter(pieces), Segments(pieces), known.value
        codec = pa.Codec("zstd", compression_level=1)
        mark = Struct("<HHH" if code == "H" else "<III").pack

        def looked_up(own: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[int, list[tuple[str, bytes | None]]]]:
            """Codes of distinct words, where each word's begin and how many there are; and of words with a segment that isn't known, their segments and what is known of their codes."""
            is_known, begin, sizes = table.words.find(own)
            new = [k for k in np.flatnonzero(~is_known).tolist() if own[k] != "\0"]
            segments, first = cut.many([spaced(own[k]) for k in new])
            is_known, at, n = table.segments.find(segments)
            codes = [table.words.codes, table.segments.codes[spread(at, n)]]
            last = np.append(first[1:], len(segments))[: len(first)]
            ends, unknown = (np.concatenate([[0], np.cumsum(x)]) for x in (n, ~is_known))
            begin[new], sizes[new] = len(codes[0]) + ends[first], ends[last] - ends[first]
            is_open = {}
            for k in np.flatnonzero(unknown[last] > unknown[first]).tolist():
                is_open[new[k]] = [(segments[j], codes[1][ends[j] : ends[j + 1]].tobytes() if is_known[j] else None) for j in range(first[k], last[k])]
            return codes, begin, sizes, is_open

        def with_holes(own: list[tuple[str, bytes | None]], rare: dict[str, int]) -> bytes:
            out = []
            for w, y in own:
                if y is None:
                    j = rare.setdefault(w, len(rare))
                    y = mark(hole, j & 0x7FFF, j >> 15)
                out.append(y)
            return b"".join(out)

        def together(names: list[str | None], texts: pa.Array) -> pa.RecordBatch:
            offsets, own = words.many(texts)
            encoded = own.dictionary_encode()
            at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            made, begin, sizes, is_open = looked_up(listed(encoded.dictionary))
            # Each place of a word with unknown segments gets codes of its own, as its document numbers them.
            opened = np.zeros(len(sizes), bool)
            opened[list(is_open)] = True
            places = np.flatnonzero(opened[at]) if len(at) else at
            docs_ = np.searchsorted(offsets, places, "right") - 1
            rare: list[dict[str, int]] = [{} for _ in names]
            holes = [with_holes(is_open[k], rare[d]) for k, d in zip(at[places].tolist(), docs_.tolist())]
            at[places] = len(sizes) + np.arange(len(places))
            more = np.array([len(x) for x in holes], np.int64) // np.dtype(code).itemsize
            begin, sizes = np.concatenate([begin, sum(map(len, made)) + np.cumsum(more) - more]), np.concatenate([sizes, more])
            codes = np.concatenate([*made, np.frombuffer(b"".join(holes), code)])[spread(begin[at], sizes[at])]
            ends = np.concatenate([[0], np.cumsum(sizes[at])])[offsets].tolist()
            keys, others, bodies = [], [], []
            for d, t, new, a, b in zip(names, listed(texts), rare, ends, ends[1:]):
                name = b"" if d is None else b"+" + d.encode()
                h = xxhash.xxh3_64_intdigest(t.replace(MARK, " ").encode("utf-8", "replace"))
                body = codes[a:b].tobytes()
                keys.append(xxhash.xxh3_64_intdigest(name, seed=h) - (1 << 63))
                others.append(h >> 33 << 32)
                bodies.append([name, h.to_bytes(8, "big") + len(body).to_bytes(8, "big") + (codec.compress(body, asbytes=True) if body else b""), *(w.encode("utf-8", "replace") for w in new)])
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(bodies, pa.list_(pa.binary()))], ["key", "other", "body"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for a, b in parts(texts, TOGETHER):
                yield together(names[a:b], texts.slice(a, b - a))
            pa.default_memory_pool().release_unused()

    # One shuffle, which both uses below read: they take the same columns of it, and no filter is pushed below it, not even that keys aren't null.
    n = 4 * common.partitions(spark)
    shape = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("other", T.LongType(), False), T.StructField("body", T.ArrayType(T.BinaryType()), False)])
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))
    placed = rows.mapInArrow(begun, shape).repartition(n, "key")
    rare = placed.select("key", "other", F.posexplode(F.slice("body", F.lit(3), F.greatest(F.lit(0), F.size("body") - 2))).alias("at", "word"))
    # Names of a row's segments: rows of equal keys are told apart by their texts' hash.
    rare = rare.select((F.col("other") + F.col("at")).alias("at"), "key", F.col("word").cast("string").alias("word"))
    folded = Fold(pieces).folded(rare, "at", "key")
    lists = folded.groupBy("key").agg(F.collect_list(F.struct("at", "path")).alias("list"))
    joined = placed.join(lists.withColumnRenamed("key", "of").hint("merge"), F.col("key") == F.col("of"), "left").select("other", "body", "list")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, codec, decode = Speller(pieces), pa.Codec("zstd"), many_decoder(pieces)
        for batch in batches:
            lists = batch.column(2)
            names, out, hashes = [], [], []

            def finished() -> pa.RecordBatch:
                lengths = np.array([0, *(len(x) for x in out)], np.int64) // np.dtype(code).itemsize
                ids = np.frombuffer(b"".join(out), code)
                # Decoded, but for the first space, it must be the text again.
                same = [xxhash.xxh3_64_digest(t[1:]) == h for t, h in zip(decode(ids, lengths[1:]), hashes)]
                offsets = pa.array(np.cumsum(lengths).astype(np.int32))
                return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_())], ["doc", "ids", "round_trip"])

            total = 0
            for k, (other, (name, body, *rare)) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                size = int.from_bytes(body[8:16], "big")
                raw = codec.decompress(body[16:], size, asbytes=True) if size else b""
                if rare:
                    codes = np.frombuffer(raw, code)
                    paths = {}
                    if lists[k].is_valid:
                        at, path = lists[k].values.flatten()
                        ends = path.offsets.to_numpy()
                        ends, values = (ends - ends[0]).tolist(), path.flatten().to_numpy().tolist()
                        paths = {x: values[a:b] for x, a, b in zip(at.to_numpy().tolist(), ends, ends[1:])}
                    found = [array(code, spell(w.decode(), paths.get(other + j))).tobytes() for j, w in enumerate(rare)]
                    parts_, last, width = [], 0, codes.itemsize
                    for p in np.flatnonzero(codes == hole).tolist():
                        parts_ += [raw[last * width : p * width], found[int(codes[p + 1]) | int(codes[p + 2]) << 15]]
                        last = p + 3
                    raw = b"".join([*parts_, raw[last * width :]])
                names.append(name[1:].decode() if name else None)
                out.append(raw)
                hashes.append(body[:8])
                total += len(raw)
                if total > TOGETHER // 2:
                    yield finished()
                    names, out, hashes, total = [], [], [], 0
            yield finished()
            pa.default_memory_pool().release_unused()

    out = joined.mapInArrow(put, "doc string, ids array<int>, round_trip boolean")
    return out.select(F.col("doc").cast(kind).alias("doc"), "ids", "round_trip")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
