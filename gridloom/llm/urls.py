"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule covers [native].

The trees are trained on the urls that the rules label, with logistic loss. Features are binned once; the labelled urls
are then only counted by their bins, and each level of each tree is one aggregation of gradients by (node, feature,
bin), so training reads all labelled urls, whatever their number, and only sums reach the driver. A trained model is a
plain SQL expression.

The shares of blocked urls by suffix and by path section are statistics of the labels, so a labelled url is trained on
the shares among other hosts: hosts are dealt over folds, and a fold's urls see the other folds' shares. A value without
labels is neutral, and no tree tells neutral urls apart: they take the value of the node they are in. As the urls to be judged often
have a suffix without labels, half of a labelled url's weight has a neutral suffix. Folds are of hosts, not of rules: a rule says one
thing of all its urls, so the other rules' shares would tend to the opposite.

Defined results: a null url or one without :// has an empty host and path, no rule, and is judged by the trees on
empty features; without labelled urls, or with labels of one kind only, the trees allow or block by that kind (allow
if there are none); repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lines import LOWER, UPPER

#: Rules: verdict, host, start of the path. Fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Bins a feature has at most.
BINS = 16
#: Folds that hosts are dealt over.
FOLDS = 10
#: The bin of a suffix or section of which no label tells anything.
NEUTRAL = -1
STATISTICS = ("suffix", "section")
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-."


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.char_length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url, all doubles."""
    whole = F.coalesce(url, F.lit(""))
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    n = F.char_length(host)
    share = lambda c: (n - F.char_length(F.replace(host, F.lit(c), F.lit("")))) / n
    entropy = F.aggregate(
        F.array(*(share(c) for c in CHARACTERS)),
        F.lit(0.0),
        lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0),
    )
    out = {
        "length": F.char_length(whole),
        "host_length": n,
        "depth": count(path, "/"),
        "labels": count(host, r"\."),
        "digits": count(whole, "[0-9]") / F.greatest(F.char_length(whole), F.lit(1)),
        "hyphens": count(host, "-"),
        "parameters": count(whole, "[?&][^?&#]+"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "last_digits": F.char_length(F.regexp_extract(path, "([0-9]*)[^0-9]*$", 1)),
    }
    return {k: v.cast("double") for k, v in out.items()}


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def section(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)", 1)


@dataclass
class UrlModel:
    """Trees of depth two over binned features; statistics of suffixes and path sections as smoothed shares of block."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    statistics: dict[str, dict[str, int]] = field(default_factory=dict)
    #: The bin of values without a statistic of their own.
    others: dict[str, int] = field(default_factory=dict)
    base: float = 0.0
    #: Splits (feature, last bin of the left, left, right, value of neutral urls); left and right are splits whose sides are values.
    trees: list[tuple] = field(default_factory=list)

    def margin(self, bins: dict[str, Column]) -> Column:
        def side(t: tuple) -> Column:
            f, at, left, right, own = t
            left, right = (side(x) if isinstance(x, tuple) else F.lit(x) for x in (left, right))
            return F.when(bins[f] == NEUTRAL, F.lit(own)).when(bins[f] <= at, left).otherwise(right)

        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + side(t)
        return out


def _split(rows: dict[tuple[str, int], tuple[float, float]], rate: float) -> tuple[str, int, float, float, float]:
    """Best (feature, bin, value left, value right, value of neutral urls) for one node's sums of gradient and hessian by feature and bin. Neutral urls keep the whole node's value, and count with what that gains."""
    best = None
    step = lambda g, h: -g / (h + 1.0)
    for f in sorted({f for f, _ in rows}):
        seen = sorted((b, g, h) for (x, b), (g, h) in rows.items() if x == f and b != NEUTRAL)
        neutral_g, neutral_h = rows.get((f, NEUTRAL), (0.0, 0.0))
        seen_g, seen_h = sum(x[1] for x in seen), sum(x[2] for x in seen)
        own = step(seen_g + neutral_g, seen_h + neutral_h)
        g = h = 0.0
        for b, dg, dh in seen:
            g, h = g + dg, h + dh
            gain = g * g / (h + 1.0) + (seen_g - g) ** 2 / (seen_h - h + 1.0) - own * (2 * neutral_g + neutral_h * own)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, b, rate * step(g, h), rate * step(seen_g - g, seen_h - h), rate * own)
    return best[1:]


def _binned(row: DataFrame, model: UrlModel) -> dict[str, Column]:
    def place(f: str, edges: list[float]) -> Column:
        return F.lit(len(edges)) - F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e >= F.col(f))) if edges else F.lit(0)

    out = {f: place(f, edges) for f, edges in model.edges.items()}
    for s, table in model.statistics.items():
        share = F.lit(model.others[s])
        for value, b in table.items():
            share = F.when(F.col(s) == value, F.lit(b)).otherwise(share)
        out[s] = share
    return out


def _shares(known: DataFrame, name: str, most_values: int) -> tuple[dict[str, int], list[dict[str, int]]]:
    """Bins of the most frequent values by all labels, and for each fold by the labels of all other folds."""
    place = lambda y, n: int((y + 1) / (n + 2) * (BINS - 1)) if n else NEUTRAL
    top = known.groupBy(name).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(most_values)
    whole = {r[name]: (r["y"], r["n"]) for r in top.collect()}
    own = known.where(F.col(name).isin(list(whole))).groupBy(name, "fold").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    folds = {(r[name], r["fold"]): (r["y"], r["n"]) for r in own.collect()}

    def outside(value: str, fold: int) -> int:
        y, n = folds.get((value, fold), (0, 0))
        return place(whole[value][0] - y, whole[value][1] - n)

    return {v: place(*x) for v, x in whole.items()}, [{v: outside(v, k) for v in whole} for k in range(FOLDS)]


def prepared(urls: DataFrame, label: str, most_values: int = 64) -> tuple[UrlModel, DataFrame | None]:
    """A model without trees, and the labelled urls counted by label and bins: (y, b_<feature>.., weight). No counts where the labels are of one kind, or there are none."""
    host, path = F.col("host"), F.col("path")
    known = urls.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int").alias("fold"), suffix(host).alias("suffix"), section(path).alias("section"), *(v.alias(k) for k, v in features(F.col("url"), host, path).items()))
    known = common.materialise(known, "url-features")
    names = [c for c in known.columns if c not in ("y", "fold", *STATISTICS)]
    first = known.agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in names)).first()
    model, n, y = UrlModel(), first["n"], first["y"] or 0.0
    if not n:
        model.base = -1.0
        return model, None
    model.base = math.log((y + 0.5) / (n - y + 0.5))
    if y in (0, n):
        return model, None
    model.edges = {f: sorted(set(first[f])) for f in names}
    outside = {}
    for s in STATISTICS:
        model.statistics[s], folds = _shares(known, s, most_values)
        model.others[s] = NEUTRAL
        maps = [F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) for table in folds]
        outside[s] = F.coalesce(F.element_at(F.element_at(F.array(*maps), F.col("fold") + 1), F.col(s)), F.lit(NEUTRAL))
    bins = _binned(known, model) | outside
    every = [f"b_{f}" for f in bins]
    counts = known.select("y", *(bins[f].cast("int").alias(f"b_{f}") for f in bins)).groupBy("y", *every).agg((F.count(F.lit(1)) / 2).alias("weight"))
    return model, common.materialise(counts.unionByName(counts.withColumn("b_suffix", F.lit(NEUTRAL))), "url-counts")


def train(urls: DataFrame, label: str, rounds: int = 8, rate: float = 0.5, most_values: int = 64) -> UrlModel:
    """Fit a model on urls with (url, host, path) and a 0/1 column. most_values: only so many of the most frequent suffixes and sections have a statistic of their own (all others are neutral), which bounds the model."""
    model, counts = prepared(urls, label, most_values)
    if counts is None:
        return model
    at = {c.removeprefix("b_"): F.col(c) for c in counts.columns if c.startswith("b_")}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin(at)))
        graded = counts.withColumn("g", F.col("weight") * (p - F.col("y"))).withColumn("h", F.col("weight") * p * (1 - p))

        def sums(node: Column) -> dict[int, dict]:
            flat = graded.select(node.alias("node"), "g", "h", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), b.alias("b")) for f, b in at.items()))).alias("x"))
            out: dict[int, dict] = {}
            for r in flat.where("node is not null").groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out.setdefault(r["node"], {})[r["f"], r["b"]] = (round(r["g"], 9), round(r["h"], 9))
            return out

        f, b, left, right, own = _split(sums(F.lit(0))[0], rate)
        nodes = sums(F.when(at[f] == NEUTRAL, None).when(at[f] <= b, 0).otherwise(1))
        side = lambda k, value: _split(nodes[k], rate) if k in nodes else (f, b, value, value, value)
        model.trees.append((f, b, side(0, left), side(1, right), own))
    return model


def scored(urls: DataFrame, model: UrlModel) -> DataFrame:
    """urls with (url, host, path), and block_chance."""
    host, path = F.col("host"), F.col("path")
    known = urls.withColumns(features(F.col("url"), host, path) | {"suffix": suffix(host), "section": section(path)})
    chance = 1 / (1 + F.exp(-model.margin(_binned(known, model))))
    return known.withColumn("block_chance", F.round(chance, 6)).drop(*features(F.col("url"), host, path), *STATISTICS)


def held_out_loss(urls: DataFrame, label: str, fold: Column, folds: int, rounds: int = 8) -> tuple[float, float]:
    """Mean log loss of labelled urls by models trained without their fold, and by the base rate of the other folds."""
    urls = common.materialise(urls.where(F.col(label).isNotNull()).withColumn("left_out", fold), "url-folds")
    loss = lambda p: F.sum(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))
    totals = [0.0, 0.0, 0]
    for k in range(folds):
        model = train(urls.where(F.col("left_out") != k), label, rounds)
        own = scored(urls.where(F.col("left_out") == k), model)
        chance = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("block_chance")))
        got = own.agg(loss(chance), loss(F.lit(1 / (1 + math.exp(-model.base)))), F.count(F.lit(1))).first()
        totals = [a + (b or 0) for a, b in zip(totals, got)]
    return totals[0] / totals[2], totals[1] / totals[2]


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, said, label) of each row; label is 1 for block, 0 for allow, null without a rule."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    return rows.withColumn("label", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int")))


def judge(pages: DataFrame, rules=RULES, rounds: int = 8) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, block_chance) of each row."""
    rows = labelled(pages, rules)
    rows = scored(rows, train(rows, "label", rounds))
    return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("said", F.when(F.col("block_chance") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_chance")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).drop("url")
