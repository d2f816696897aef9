"""Vector bin packing: examples into sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

An example is a vector of its tokens, its one segment and its loss-bearing tokens. A sequence is filled at a time: of the
examples that fit what is left under every limit, the one of the largest dot product with what is left goes in, each limit
as a share and weighted by how much of it the examples on hand ask for. Where none fits and room is left, the example of the largest dot
product is cut and its head fills the room; its tail goes back to the others. A sequence needs no padding if it is full, or if
its length is a power of two (it then goes into batches of that length); one that another limit or the end of the input leaves short
is cut back to the largest power of two. So there is no padding at all, and at most one example in a sequence is cut beyond those that are too long.

Tasks pack what they read, without a shuffle: a window of examples is on hand, of bounded count and tokens, and goes on to the end
of the partition, so that only there a few short sequences arise. Examples of equal vectors are one kind with a
stack of examples. An example longer than a sequence is cut into full ones first.

Defined results: a null text (or prompt) is an empty one, and so an example of the end id alone; every row is an example of its own,
repeated ids and texts too; an empty table gives an empty result. A prompt's tokens bear no loss, nor does an example's first token, which nothing predicts.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordpieces import word_encoder

CAPACITY, SEGMENTS = 2048, 64
#: Examples and tokens on hand in a task; bytes encoded at once.
WINDOW, WINDOW_TOKENS, AT_ONCE = 4096, 8_000_000, 2_000_000
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Example:
    """Ids of an example from place start on, of total in all; the first loss_from of those bear no loss."""

    __slots__ = ("doc", "ids", "start", "loss_from", "total")

    def __init__(self, doc, ids: bytes, start: int, loss_from: int, total: int):
        self.doc, self.ids, self.start, self.loss_from, self.total = doc, ids, start, loss_from, total

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def loss(self, tokens: int) -> int:
        """Loss-bearing ones of the first tokens."""
        return max(0, self.start + tokens - max(self.start, self.loss_from))

    def cut(self, tokens: int) -> tuple[Example, Example]:
        head = Example(self.doc, self.ids[: 4 * tokens], self.start, self.loss_from, self.total)
        return head, Example(self.doc, self.ids[4 * tokens :], self.start + tokens, self.loss_from, self.total)


class Pool:
    """Kinds of examples by (tokens, loss-bearing tokens), and sequences made of them."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits, self.tokens, self.count = limits, 0, 0
        self.kinds: dict[tuple[int, int], int] = {}
        self.held: list[list[Example]] = []
        self.at = np.zeros((2, 64))
        self.many = np.zeros(64, np.int64)

    def add(self, x: Example) -> None:
        own = (x.tokens, x.loss(x.tokens))
        k = self.kinds.setdefault(own, len(self.held))
        if k == len(self.held):
            self.held.append([])
            if k == self.at.shape[1]:
                self.at, self.many = np.concatenate([self.at, np.zeros_like(self.at)], axis=1), np.concatenate([self.many, np.zeros_like(self.many)])
            self.at[:, k] = own
        self.held[k].append(x)
        self.many[k] += 1
        self.tokens += own[0]
        self.count += 1

    def _take(self, k: int) -> Example:
        self.many[k] -= 1
        self.tokens -= int(self.at[0, k])
        self.count -= 1
        return self.held[k].pop()

    def tidy(self) -> None:
        """Forget kinds without examples; of equal dot products the longest comes first."""
        own = [x for held in self.held for x in held]
        self.__init__(self.limits)
        for x in sorted(own, key=lambda x: -x.tokens):
            self.add(x)

    def sequence(self) -> list[Example]:
        """The pieces of the next sequence, in order."""
        tokens, segments, loss = self.limits
        out: list[Example] = []
        room, bears = tokens, loss
        while room and len(out) < segments and self.count:
            n = len(self.held)
            size, bearing, many = self.at[0, :n], self.at[1, :n], self.many[:n]
            if not out:
                # How much of each limit the examples on hand ask for. A piece takes one segment whatever it is, so segments add the same to every dot product.
                w_tokens, w_loss = (size @ many) / tokens**3, (bearing @ many) / loss**3
            at = np.flatnonzero((size <= room) & (bearing <= bears) & (many > 0))
            if len(at):
                k = int(at[np.argmax(size[at] * (w_tokens * room) + bearing[at] * (w_loss * bears))])
                x = self._take(k)
            else:
                # Loss-bearing tokens are an example's last ones: without room for any, only what has others before them is cut.
                at = np.flatnonzero(many > 0 if bears else (many > 0) & (size > bearing))
                if not len(at):
                    break
                k = int(at[np.argmax(size[at] * (w_tokens * room) + bearing[at] * (w_loss * bears))])
                x = self._take(k)
                x, rest = x.cut(min(room, max(0, x.loss_from - x.start) + bears))
                self.add(rest)
            out.append(x)
            room -= x.tokens
            bears -= x.loss(x.tokens)
        spare = 0 if not room else tokens - room - (1 << (tokens - room).bit_length() - 1)
        while spare:
            x = out.pop()
            kept, back = x.cut(max(0, x.tokens - spare))
            if kept.ids:
                out.append(kept)
            self.add(back)
            spare -= back.tokens
        return out


def sequences(examples: Iterable[Example], limits: tuple[int, int, int]) -> Iterator[list[Example]]:
    """All examples as sequences, from a window that goes along."""
    tokens, _, loss = limits
    pool = Pool(limits)
    for x in examples:
        if x.tokens >= tokens and x.loss(tokens) <= loss:
            # A view, so that cutting a long example again and again copies nothing.
            x.ids = memoryview(x.ids)
            while x.tokens >= tokens and x.loss(tokens) <= loss:
                head, x = x.cut(tokens)
                yield [head]
            x.ids = bytes(x.ids)
        if x.ids:
            pool.add(x)
        if pool.count >= WINDOW or pool.tokens >= WINDOW_TOKENS:
            while pool.count > WINDOW // 2 or pool.tokens > WINDOW_TOKENS // 2:
                yield pool.sequence()
            pool.tidy()
    pool.tidy()
    while pool.count:
        yield pool.sequence()


def pack(docs: DataFrame, text: str = "text", doc: str = "doc_id", prompt: str | None = None, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, ids: bool = False) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, and with ids its ids, 32-bit little-endian.

    capacity, segments, loss: the most tokens, pieces and loss-bearing tokens of a sequence (loss None: as many as tokens). prompt: a
    column whose tokens come before the text's and bear no loss.
    """
    limits = (capacity, segments, capacity if loss is None else loss)
    if min(limits) < 1:
        raise ValueError("limits are of one or more")
    end = np.uint32(end_id).tobytes()
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit(None).cast("string")).alias("prompt"))
    kind = rows.schema["doc"].dataType.simpleString()

    def examples(batches: Iterator[pa.RecordBatch], encode) -> Iterator[Example]:
        for batch in batches:
            keys, texts, prompts = batch.column(0).to_pylist(), *(batch.column(k).cast(pa.binary()).to_pylist() for k in (1, 2))
            at = 0
            while at < len(keys):
                to, size = at, 0
                while to < len(keys) and (to == at or size < AT_ONCE):
                    size += len(texts[to]) + len(prompts[to] or b"")
                    to += 1
                encoded = encode(texts[at:to])
                before = encode(prompts[at:to]) if prompt else [b""] * (to - at)
                for key, p, t in zip(keys[at:to], before, encoded):
                    own = p + t + end
                    yield Example(key, own, 0, max(1, len(p) // 4), len(own) // 4)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        doc_type = None

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if ids:
                arrays.append(pa.array(columns[7], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        def seen(batches):
            nonlocal doc_type
            for b in batches:
                doc_type = b.schema.field(0).type
                yield b

        # Nothing here makes cycles, and a collector that looks at every remembered chunk takes a fifth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            for k, pieces in enumerate(sequences(examples(seen(batches), word_encoder(tokenizer)), limits)):
                offset = 0
                for x in pieces:
                    out.append((x.doc, x.start, x.tokens, zlib.crc32(x.ids), x.total, first + k, offset, bytes(x.ids) if ids else None))
                    offset += x.tokens
                if len(out) >= 8192:
                    yield batch_of()
                    out.clear()
            if out:
                yield batch_of()
        finally:
            if collects:
                gc.enable()

    return rows.mapInArrow(run, f"doc {kind}, {PIECE}" + ", ids binary" * ids)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
