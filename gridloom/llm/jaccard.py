"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact verification for links.

A document's set are the hashes of its windows of five words (of all its words, if it has fewer). Documents with equal
sets are one class member from there on. A forest has TREES prefix tries; a member's key in a tree is a sequence of
DEPTH MinHash values, and two members meet in a tree where their keys share a prefix, which is a node of the trie: members
are brought together by prefix. Matching starts at full depth; what meets there goes on as one group. The prefix is then
shortened, for all trees and groups alike, until the target recall is reached, or down to the depth at which even links at the threshold, the
worst case, meet in some tree with that recall. How much is still missing is estimated from all verified links: one of likeness J meets at a
depth with a known probability p(J), above 0.99 at every depth for every link, so each link that was found stands for (1 - p) / p links that
were not. Links less alike than any found could be missing as a whole; as many of them as could have stayed unseen together, but for a
chance of 1 - recall, count as missing too, so that few links never end the search early.

Members that meet are put into candidate groups (components over the tries' nodes). All pairs of a group are verified
exactly, but never as rows: a group is cut into blocks of bounded size, each pair of blocks is one unit of work, and what
a unit returns is for each member its number of links and the least member it is connected with. A shorter prefix only makes groups grow;
those that stay as they are aren't verified again. Components over the links give the classes.

Defined results: a null text is an empty one; texts without words have no links and are a class by themselves each; a
null id counts as the least id; rows with equal ids are told apart by their sets (links and classes are those of sets, which have numbers
of their own; classes of different texts with equal ids may share a class_id, as it is an id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graphs

WORDS = 5
TREES, DEPTH = 25, 7
#: Shingles and members of a block of a candidate group.
BLOCK_SHINGLES, BLOCK_MEMBERS = 120_000, 400
SLOTS = 64
_MIX = np.random.default_rng(5).integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROTATE = np.random.default_rng(6).integers(1, 1 << 63, (1, TREES * DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the windows of a text (UTF-8). bytes.split() splits at the six ASCII white-space characters."""
    words = (text or b"").split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        total = h[:n] * _MIX[0]
        for k in range(1, WORDS):
            total = _mixed(total) + h[k : k + n] * _MIX[k]
        return np.unique(_mixed(total))
    if not len(h):
        return h
    return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)


def depth_for(threshold: float, recall: float) -> int:
    """The greatest depth at which sets at the threshold meet in some tree with the wanted probability."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def apart(likeness, depth: int):
    """The probability that two sets of some likeness meet in no tree."""
    return (1 - likeness**depth) ** TREES


def shortened(depth: int, links: int, missed: dict[int, float], threshold: float, recall: float) -> int:
    """The greatest depth up to `depth`, where `links` links have met, that reaches the recall by the estimate. missed: links that each depth is estimated to lose."""
    floor = depth_for(threshold, recall)
    unseen = math.ceil(math.log(1 - recall) / math.log(apart(threshold, depth)))
    for d in range(depth, floor, -1):
        lost = missed[d] + unseen
        if lost <= (1 - recall) * (links + lost):
            return d
    return floor


def minhashes(own: np.ndarray) -> bytes:
    """Each tree's DEPTH MinHash values, two bytes each."""
    least = np.full(_ROTATE.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        np.minimum(least, (own[k : k + 512, None] * _ROTATE).min(axis=0), out=least)
    return _mixed(least).astype("<u2").tobytes()


def _key(own: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(own.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def signatures(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """(doc, text_key, k1, k2, n, signature): a hash of the text, the set's 128-bit hash and size, and the keys in all tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, n, keys = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingles(t)
                a, b = _key(own)
                k1.append(a)
                k2.append(b)
                n.append(len(own))
                keys.append(minhashes(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["doc", "text_key", "k1", "k2", "n", "signature"])

    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "doc long, text_key long, k1 long, k2 long, n long, signature binary")


def candidate_edges(members: DataFrame, depth: int) -> DataFrame:
    """(a, b): the numbers of each member and of the least member of each node at a depth that it shares. Members with one number are one. A node's rows are spread over slots, so no node meets in one task."""
    tree = F.col("tree")
    prefix = F.substring("signature", tree * (2 * DEPTH) + 1, F.lit(2 * depth))
    at = members.select("number", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    at = at.select("number", F.xxhash64("tree", prefix).alias("node"), F.pmod(F.xxhash64("number", "signature"), F.lit(SLOTS)).cast("int").alias("slot"))
    nodes = at.groupBy("node").agg(F.min("number").alias("least"), F.max("number").alias("most"), F.bit_or(F.expr("shiftleft(1L, slot)")).alias("slots")).where("least != most")
    nodes = nodes.select("node", "least", F.explode(F.expr(f"filter(sequence(0, {SLOTS - 1}), s -> getbit(slots, s) = 1)")).alias("slot"))
    return at.join(nodes, ["node", "slot"]).where("number != least").select(F.col("number").alias("a"), F.col("least").alias("b")).distinct()


def grouped_at(members: DataFrame, depth: int, before: DataFrame | None = None) -> DataFrame:
    """(number, group) of the members that meet others at a depth, group being the least number. before: the groups at a greater depth, each of which goes on as one member."""
    if before is None:
        return graphs.components(candidate_edges(members, depth)).select(F.col("v").alias("number"), F.col("l").alias("group"))
    own = members.select("number", "signature").join(before.select("number", F.col("group").alias("at")), "number", "left").withColumn("v", F.coalesce("at", "number"))
    short = graphs.components(candidate_edges(own.select(F.col("v").alias("number"), "signature"), depth))
    return own.join(short, "v", "left").select("number", F.coalesce("l", "at").alias("group")).where("group is not null")


def candidate_groups(members: DataFrame, depth: int) -> DataFrame:
    """(number, group) at a depth, by way of the groups at full depth."""
    full = grouped_at(members, DEPTH)
    return full if depth == DEPTH else grouped_at(members, depth, full)


def units(groups: DataFrame) -> DataFrame:
    """(number, member, text_key, k1, k2, copies, group, size, i, j, second): the units of work that each member takes part in. groups: (number, member, text_key, k1, k2, n, copies, group). size: members of the group; as groups only grow, (group, size) tells its states apart."""
    members = F.count(F.lit(1))
    sizes = groups.groupBy("group").agg(members.alias("size"), F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(members / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    rows = groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("number", F.lit(23)), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = ["number", "member", "text_key", "k1", "k2", "copies", "group", "size"]
    rows = rows.select(*own, "block", F.explode(other).alias("other"))
    return rows.select(*own, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))


def verified(members: list[tuple[int, int, bool, np.ndarray]], within: bool, ratio: tuple[int, int], depths: list[int]) -> list[tuple[int, ...]]:
    """(number, least connected number, links, linked documents, for each depth: billionths of links that its links stand for and that don't meet there) of a unit's members that have links. members: (number, copies, second side, set); within: one block against itself, else first against second side. ratio: threshold as a fraction."""
    p = len(members)
    if p < 2:
        return []
    sizes = np.array([len(m[3]) for m in members], np.int64)
    everything = np.concatenate([m[3] for m in members])
    row = np.repeat(np.arange(p), sizes)
    order = np.argsort(everything, kind="stable")
    everything, row = everything[order], row[order]
    new = np.concatenate([[True], everything[1:] != everything[:-1]])
    column = np.cumsum(new) - 1
    counts = np.bincount(column)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common_ = np.zeros((p, p), np.float64)
    width = max(1, (1 << 22) // p)
    for a in range(0, int(column.max()) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((p, width), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        common_ += x @ x.T
    top, bottom = ratio
    linked = (top + bottom) * common_ >= top * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if not within:
        second = np.array([m[2] for m in members])
        linked &= second[:, None] != second[None, :]
    ids = np.array([m[0] for m in members], np.int64)
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    while True:
        least = np.where(linked, label[None, :], p).min(axis=1)
        now = np.minimum(label, least)
        if (now == label).all():
            break
        label = now
    by_rank = np.sort(ids)
    links, docs = linked.sum(1), linked @ np.array([m[1] for m in members], np.int64)
    a, b = np.nonzero(linked)
    likeness = common_[a, b] / (sizes[a] + sizes[b] - common_[a, b])
    q = [apart(likeness, d) for d in depths]
    missed = [np.rint(1e9 * np.bincount(a, x / (1 - x), p)).astype(np.int64) for x in q]
    return [(int(ids[i]), int(by_rank[label[i]]), int(links[i]), int(docs[i]), *(int(m[i]) for m in missed)) for i in np.flatnonzero(links)]


def links(docs: DataFrame, work: DataFrame, text: str, doc: str, threshold: tuple[int, int], depths: list[int]) -> DataFrame:
    """(number, least, links, docs, missed<depth>.., group, size) for each unit and member with links."""
    whole = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("member"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    # By text, too: rows of one id (null, say) meet the units of their own sets only.
    rows = whole.join(work.hint("merge"), ["member", "text_key"])
    placed = rows.repartition(max(common.partitions(docs.sparkSession), 1), "group", "i", "j").sortWithinPartitions("group", "i", "j", "number")
    names = ["number", "least", "links", "docs", *(f"missed{d}" for d in depths), "group", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, taken = None, [], set()

        def emit() -> pa.RecordBatch:
            found = verified(held, unit[2] == unit[3], threshold, depths)
            columns = list(zip(*found)) or [()] * (len(names) - 2)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.array([x] * len(found), pa.int64()) for x in unit[:2])], names)

        for batch in batches:
            batch = batch.select(["number", "text", "k1", "k2", "copies", "group", "size", "i", "j", "second"])
            texts = batch.column(1).cast(pa.binary())
            rest = [batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7, 8, 9)]
            for at, (number, k1, k2, copies, group, size, i, j, second) in enumerate(zip(*rest)):
                if unit != (group, size, i, j):
                    if held:
                        yield emit()
                    unit, held, taken = (group, size, i, j), [], set()
                if number in taken:
                    continue
                own = shingles(texts[at].as_py())
                # Texts whose id and hash are the member's but whose set isn't are other documents.
                if _key(own) == (k1, k2):
                    taken.add(number)
                    held.append((number, copies, second, own))
        if held:
            yield emit()

    return placed.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def linked(docs: DataFrame, members: DataFrame, text: str, doc: str, threshold: tuple[int, int], recall: float) -> tuple[DataFrame, DataFrame]:
    """(found, work): links() and units() of the candidate groups, at the depth where the recall is reached. members: (number, member, text_key, k1, k2, n, copies, signature)."""
    t = threshold[0] / threshold[1]
    floor = depth_for(t, recall)
    depths = list(range(floor, DEPTH + 1))
    state = ["group", "size"]
    depth, groups = DEPTH, None
    found = work = None
    while True:
        before = groups
        groups = grouped_at(members, depth, before)
        groups = common.materialise(members.drop("signature").join(groups, "number"), "groups")
        own = units(groups)
        if work is not None:
            own = own.join(work.select(*state).distinct(), state, "left_anti")
        own = common.materialise(own, "units")
        common.release(docs.sparkSession)
        new = common.materialise(links(docs, own, text, doc, threshold, depths), "links")
        if work is None:
            found, work = new, own
        else:
            # What has grown was verified anew.
            now = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
            found, work = (x.join(now, state, "left_semi").select(*y.columns).unionByName(y) for x, y in ((found, new), (work, own)))
        if depth == floor:
            return found, work
        total = found.agg(F.sum("links").alias("links"), *(F.sum(f"missed{d}").alias(f"missed{d}") for d in depths)).first()
        least = shortened(depth, (total["links"] or 0) // 2, {d: (total[f"missed{d}"] or 0) / 2e9 for d in depths}, t, recall)
        if least == depth:
            return found, work
        depth = least


def classified(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """(doc, text_key, class_number, class_id, member, n_copies, n_links, n_linked_docs) of each row: those of join(), the text's xxhash64, and a number that only rows of the same class share (null for a text without words)."""
    rows = common.materialise(signatures(docs, text, doc), "signatures")
    full = rows.where("n > 0")
    members = full.groupBy("k1", "k2").agg(F.min(F.struct("doc", "text_key")).alias("x"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    members = members.select("k1", "k2", F.col("x.doc").alias("member"), "x.text_key", "copies", "n", "signature")
    # Sets may share an id; once written, numbers are theirs alone.
    members = common.materialise(members.withColumn("number", F.monotonically_increasing_id()), "members")
    found, work = linked(docs, members, text, doc, threshold, recall)
    # Where a group was one unit its labels are final; the others' are edges.
    many = work.where("j > 0").select("group").distinct()
    edges = found.join(many, "group", "left_semi").where("number != least").select(F.col("number").alias("a"), F.col("least").alias("b"))
    final = graphs.components(edges).select(F.col("v").alias("number"), F.col("l").alias("over"))
    totals = found.groupBy("number").agg(F.min("least").alias("least"), F.sum("links").alias("links"), F.sum("docs").alias("docs")).join(final, "number", "left")
    totals = totals.withColumn("class_number", F.coalesce("over", "least")).drop("over", "least").join(members.select("number", "member"), "number")
    totals = common.materialise(totals, "linked")
    ids = totals.groupBy("class_number").agg(F.min("member").alias("class_id"))
    totals = members.select("k1", "k2", "number", "member", "copies").join(totals.drop("member").join(ids, "class_number"), "number", "left").select(
        "k1", "k2", "member", "copies",
        F.coalesce("class_number", "number").alias("class_number"), F.coalesce("class_id", "member").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("docs", F.lit(0)).alias("docs"),
    )
    totals = common.materialise(totals, "classes")
    out = rows.select("doc", "text_key", "k1", "k2", "n").join(totals, (rows.k1 == totals.k1) & (rows.k2 == totals.k2) & (rows.n > 0), "left")
    return out.select(
        "doc",
        "text_key",
        "class_number",
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("member", "doc").alias("member"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).alias("n_linked_docs"),
    )


def join(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """(doc, class_id, member, n_copies, n_links, n_linked_docs) of each row.

    class_id: the least id connected by links; member: the least id with an equal set; n_links: other sets at or above
    the threshold; n_linked_docs: other documents, copies among them.
    """
    return classified(docs, text, doc, threshold, recall).drop("text_key", "class_number")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
