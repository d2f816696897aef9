"""A corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
one's docs. All but the last return the columns of documents; n_chars follows the text. Each stage works on all that the
one before has kept, whatever its size; null texts are empty ones; repeated rows are rows of their own until the near-duplicate
stage, which keeps one document of each class; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import common, jaccard, lines, packing, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    docs = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    judged = quality.judged(docs, common.table(spark, sf_dir, "labels"), also=("text_key",))
    gone = judged.where(~F.col("kept")).select(F.col("doc").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("text_key") == F.col("gone_key")), "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; a document whose lines all go stays, empty."""
    kept = lines.frequent_lines(docs, also=("lang", "source"))
    return kept.select(F.col("doc").alias("doc_id"), F.col("kept").alias("text"), F.col("also.lang").alias("lang"), F.col("also.source").alias("source"), F.char_length("kept").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays (of its texts, if it has several in the class, that of least hash)."""
    classes = jaccard.classified(docs)
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = F.struct(F.col("doc").alias("stays"), "text_key")
    of_class = classes.where("class_number is not null").groupBy("class_number").agg(F.min(own).alias("x")).select("x.*")
    stays = of_class.unionByName(classes.where("class_number is null").select(F.col("doc").alias("stays"), "text_key")).distinct()
    first = F.row_number().over(W.partitionBy("stays", "text_key").orderBy("lang", "source"))
    kept = docs.select(*COLUMNS, least.alias("stays"), F.xxhash64("text").alias("text_key")).join(stays.hint("merge"), ["stays", "text_key"], "left_semi")
    return kept.withColumn("nth", first).where("nth = 1").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.learn(docs))
    return clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack(docs).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: Bounds, automata and packing aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
