"""Connected components by contraction; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(v, l): each vertex of edges (a, b: long) and the least vertex that it is connected with.

    A round lets each vertex point at the vertex of least priority around it (or itself), follows that pointer once more, and
    replaces the edges by those between different targets, until there are none. In every other round priorities are ids, which takes
    stars around their least vertex at once; in the rounds between they are hashes that differ by round, so that whatever the order of
    ids at most about two thirds of the vertices are left on average. The vertex of greatest priority is never a target, so rounds end.
    The pointers of all rounds, followed one after the other, end at one vertex of each component.
    """
    edges = common.materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u"))))
    labels = None
    turn = 0
    while labels is None or not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("at")) if turn % 2 else F.struct(F.col(c).alias("at"))
        around = edges.select(ends.alias("x")).select("x.v", "x.u")
        least = around.groupBy("v").agg(F.min(ranked("u")).alias("m"))
        first = common.materialise(least.select("v", F.least("m", ranked("v"))["at"].alias("p")), "pointers")
        second = first.select(F.col("v").alias("p"), F.col("p").alias("q"))
        pointers = common.materialise(first.join(second, "p").select("v", F.col("q").alias("l")), "pointers")
        spent = [first, edges]
        if labels is None:
            labels = pointers
        else:
            on = pointers.select(F.col("v").alias("l"), F.col("l").alias("to"))
            spent += [labels, pointers]
            labels = common.materialise(labels.join(on, "l", "left").select("v", F.coalesce("to", "l").alias("l")), "labels")
        of_a, of_b = (pointers.select(F.col("v").alias(c), F.col("l").alias(f"l{c}")) for c in "ab")
        half = edges.join(of_a, "a").select("b", F.col("la").alias("a")).where("a != b").distinct()
        edges = half.join(of_b, "b").select("a", F.col("lb").alias("b")).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = common.materialise(edges, "edges")
        common.discard(*spent)
        turn += 1
    names = labels.groupBy("l").agg(F.min("v").alias("name"))
    return common.materialise(labels.join(names, "l").select("v", F.col("name").alias("l")), "labels")
