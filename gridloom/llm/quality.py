"""Quality rules with risk-controlled thresholds [native].

Every text gets fixed base rules and a badness score: the largest of a few signals (share of symbols, of repeated lines,
of repeated words, of exclamation marks, of capitals, of table bars), each divided by its size at the far end of all texts, labelled or
not. So all clean labelled texts are holdout. On them the cutoffs of a fixed grid are tested for each stratum in a fixed
sequence, from the highest down, while the exact (Clopper-Pearson) upper bound of the share of clean texts above the
cutoff, at error rate delta divided by the number of strata, doesn't pass alpha; the last that passed becomes the
stratum's, and with none nothing is rejected. A sequence that ends at the first failure needs no further correction for
its tests, the strata do: with probability 1 - delta no stratum loses more than alpha of its clean texts.

Defined results: a null text has no words and fails the base rules; a stratum without enough labels rejects nothing by
score; each row is judged by itself, repeated rows alike; labels that are null or of unknown documents don't count; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
SIGNALS = ("symbols", "dup_lines", "repeats", "bangs", "capitals", "bars")
#: Cutoffs tested for each stratum, in units of the clean texts' far end.
CUTOFFS = [round(2.0 * 1.25**i, 4) for i in range(12)]


def _count(text: Column, characters: str) -> Column:
    """How often the (single-byte) characters are in a text."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def repeated_words(w: Column) -> Column:
    """Words covered by the three-word windows that are in the list twice or more.

    The windows' 64-bit hashes are sorted with their places; neighbours alike are repeats. Going through the repeats'
    sorted places, each covers up to three words, less what the next one covers too.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    places = common.let(
        F.array_sort(windows),
        lambda s: F.array_sort(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k + 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k - 1)["h"].eqNullSafe(x["h"]))),
                lambda x: x["p"],
            )
        ),
    )
    covered = common.let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(covered).cast("long")


def measured(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns, the base figures and the signals of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(common.WS)) != "")
    figures = docs.select(
        *keep,
        common.let(
            common.words(F.col(text)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        _count(whole, SYMBOLS).alias("n_symbols"),
        _count(whole, "!").alias("n_bangs"),
        _count(whole, "|").alias("n_bars"),
        (F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        common.let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    n = F.col("w.n_words")
    return figures.select(
        *keep,
        n.alias("n_words"),
        F.col("w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        ratio(F.col("n_symbols"), n).alias("symbols"),
        ratio(F.col("l.dup"), F.col("l.n")).alias("dup_lines"),
        ratio(F.col("w.n_repeat_words"), n).alias("repeats"),
        ratio(F.col("n_bangs"), n).alias("bangs"),
        ratio(F.col("n_capitals"), F.col("w.word_chars")).alias("capitals"),
        ratio(F.col("n_bars"), n).alias("bars"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still has probability error; by bisection on the exact binomial sum."""
    if n == 0 or k >= n:
        return 1.0

    def tail(p: float) -> float:
        at = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(at)
        return top + math.log(sum(math.exp(x - top) for x in at))

    low, high = k / n or 1e-300, 1.0 - 1e-15
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > math.log(error) else (low, mid)
    return high


def scales(rows: DataFrame) -> dict[str, float]:
    """The far end of each signal: its 90th percentile, at least a floor under which no text is odd."""
    floors = {"symbols": 0.02, "dup_lines": 0.1, "repeats": 0.1, "bangs": 0.05, "capitals": 0.15, "bars": 0.05}
    row = rows.agg(*(F.percentile_approx(s, 0.9, 10_000).alias(s) for s in SIGNALS)).first()
    return {s: max(floors[s], row[s] or 0.0) for s in SIGNALS}


def score(scale: dict[str, float]) -> Column:
    return F.greatest(*(F.col(s) / F.lit(scale[s]) for s in SIGNALS))


def cutoffs(holdout: DataFrame, stratum: str, alpha: float, delta: float) -> dict[object, float]:
    """Each stratum's last cutoff, from the highest down, before the first whose bound fails. holdout: clean rows with stratum and score. All strata's counts at all cutoffs come from one aggregation."""
    counts = holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("score") > c, 1)).alias(f"c{i}") for i, c in enumerate(CUTOFFS))).collect()
    out = {}
    for row in counts:
        for i, c in reversed(list(enumerate(CUTOFFS))):
            if upper_bound(row[f"c{i}"], row["n"], delta / len(counts)) > alpha:
                break
            out[row[stratum]] = c
    return out


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = 0.02, delta: float = 0.05, also: tuple[str, ...] = ()) -> DataFrame:
    """Each row's doc, figures, score, cutoff and kept. alpha: the most clean texts a stratum may lose; delta: the chance that any stratum loses more. also: columns of docs that come along; they mustn't have a result's name.

    The number of strata must be small (languages, sources): their counts go to the driver.
    """
    rows = common.materialise(measured(docs.select(F.col(doc).alias("doc"), F.col(stratum).alias("stratum"), F.col(text).alias("text"), *also), "text", "doc", "stratum", *also), "quality")
    clean = labels.where(F.col(label) == 1).select(F.col(doc).alias("doc")).where("doc is not null").distinct()
    judged_ = rows.where(~F.col("base_failed"))
    scale = scales(judged_)
    found = cutoffs(judged_.join(clean, "doc", "left_semi").withColumn("score", score(scale)), "stratum", alpha, delta)
    cutoff = F.lit(None).cast("double")
    for value, c in found.items():
        cutoff = F.when(F.col("stratum").eqNullSafe(F.lit(value)), F.lit(c)).otherwise(cutoff)
    return rows.withColumn("score", score(scale)).withColumn("cutoff", cutoff).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return rows.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("stratum").alias("lang"), F.round("score", 6).alias("score"), "cutoff")
