"""Line dedup over levelled sorted runs of line hashes [native].

The store is a small log-structured merge tree in the shared folder. Its runs are tables of line keys, hashed to 128
bits, bucketed and sorted by them alike, each key with the number of documents that brought it. No two runs share a
key: a new batch is merge-anti-joined with every run, and only its new keys become a run of level 0; those that a run
has are the batch's hits. When a level has `fanout` runs they are merged, in order, into one run of the next level, so
every key is rewritten once a level. As buckets and order are the same everywhere, joins and merges of runs need
neither shuffle nor sort.

Two uses:

* `LineRuns.admit(docs)`: streaming dedup; every line that an earlier batch has is dropped.
* `frequent_lines(docs, min_docs)`: all batches are admitted first; a key's documents are those of its run and of its
  hits, and each line whose key at least min_docs documents hold is dropped from all of them.

Defined results: a null or empty text is one empty line; keys shorter than min_chars never count and always stay;
each row is a document of its own, even where doc_id repeats or is null; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slots over which the rows of one key are spread in joins; one bit of a long for each.
SALTS = 64


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else. Where all characters are ASCII the much faster lower() does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(lowered(text), "\n"), lambda x: F.btrim(x, F.lit(common.WS)))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def line_hashes(docs: DataFrame, text: str, doc: str, min_chars: int) -> DataFrame:
    """(row, h1, h2, salt): one row for each distinct key of a document; row: a hash of its id and text."""
    flat = docs.select(
        F.xxhash64(doc, text).alias("row"),
        F.explode(F.array_distinct(F.filter(keys(F.coalesce(F.col(text), F.lit(""))), lambda k: F.char_length(k) >= min_chars))).alias("key"),
    )
    return flat.select("row", *hashed(F.col("key")), F.pmod(F.xxhash64("row", F.lit(3)), F.lit(SALTS)).cast("int").alias("salt"))


def counted(lines: DataFrame) -> DataFrame:
    """A run's rows: documents of each key, and a bit for each slot that has rows of it. Combined before the shuffle, so a hot key costs a row a task."""
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("slots"))


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Lets the planner rely on the order within a bucket, which it does if each is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, slots), and the hits of batches, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, common.partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.hits: list[DataFrame] = []
        self.tables: dict[int, str] = {}

    def _write(self, run: DataFrame) -> DataFrame:
        """A table of rows that are hashed by (h1, h2) to as many partitions as there are buckets, so that each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            run.write.format("parquet").option("path", common.scratch_path(self.spark, "line-run")).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        out = self.spark.table(name)
        self.tables[id(out)] = name
        return out

    def _drop(self, *runs: DataFrame) -> None:
        """Take runs that nothing reads any more from the catalogue, and their files away."""
        for r in runs:
            name = self.tables.pop(id(r))
            path = next(x["data_type"] for x in self.spark.sql(f"DESCRIBE EXTENDED {name}").collect() if x["col_name"] == "Location")
            self.spark.sql(f"DROP TABLE {name}")
            common.remove(self.spark, path)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def batch(self, lines: DataFrame) -> DataFrame:
        """A batch's keys as a table like a run."""
        return self._write(counted(lines))

    def split(self, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A batch's keys that no run has, and those that one has: a merge anti-join with each run, and merge semi-joins."""
        fresh, known = own, None
        for r in self.runs():
            found = own.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_semi")
            known = found if known is None else known.unionByName(found)
            fresh = fresh.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return fresh, own.where("false") if known is None else known

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs in order: a merge full join, as they share no key."""
        b = b.select("h1", "h2", F.col("n").alias("n2"), F.col("slots").alias("slots2")).hint("merge")
        return a.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("n", "n2").alias("n"), F.coalesce("slots", "slots2").alias("slots"))

    def add(self, own: DataFrame) -> DataFrame:
        """Admit a batch's keys: hits are kept aside, new keys become a run of level 0, and every level that is full is compacted. Returns the hits."""
        if not self.runs():
            fresh, known = own, own.where("false")
        else:
            with _sorted_buckets(self.spark):
                new, known = self.split(own)
                fresh = self._write(new)
                known = common.materialise(known, "line-hits")
            self.hits.append(known)
            self._drop(own)
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(fresh)
            if len(self.levels[level]) < self.fanout:
                return known
            full, self.levels[level] = self.levels[level], []
            fresh = full[0]
            for r in full[1:]:
                with _sorted_buckets(self.spark):
                    merged = self._write(self._merged(fresh, r))
                self._drop(fresh, r)
                fresh = merged
            level += 1

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, slots) of the keys that so many documents or more brought, in runs and hits together."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, slots long")
        hits = None
        for h in self.hits:
            hits = h if hits is None else hits.unionByName(h)
        out = None
        with _sorted_buckets(self.spark):
            again = self._write(hits.groupBy("h1", "h2").agg(F.sum("n").alias("n2"), F.bit_or("slots").alias("slots2"))) if hits is not None else None
            for r in self.runs():
                rows = r if again is None else r.join(again.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("slots").bitwiseOR(F.coalesce("slots2", F.lit(0))).alias("slots"))
                rows = rows.where(F.col("n") >= least).select("h1", "h2", "slots")
                out = rows if out is None else out.unionByName(rows)
            return common.materialise(out, "line-frequent")

    def close(self) -> None:
        """Drop all tables."""
        self._drop(*(r for r in self.runs()))
        for name in list(self.tables.values()):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.tables = [], {}

    def admit(self, docs: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = 1) -> DataFrame:
        """(doc, n_lines, n_dropped, kept): the batch without the lines that earlier batches have. One row for each input row."""
        lines = common.materialise(line_hashes(docs, text, doc, min_chars), "line-batch")
        known = self.add(self.batch(lines))
        return dropped(docs, row_drops(lines, known), text, doc)


def row_drops(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, drops): for each document the hashes of its lines whose key is among keys. Keys are joined slot by slot, so the rows of a hot key are spread over SALTS tasks, and only slots that have rows are repeated."""
    slots = keys.select("h1", "h2", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(slots, s) = 1)")).alias("salt"))
    return lines.join(slots, ["h1", "h2", "salt"], "left_semi").groupBy("row").agg(F.collect_set("h1").alias("drops"))


def dropped(docs: DataFrame, drops: DataFrame, text: str, doc: str, also: tuple[str, ...] = ()) -> DataFrame:
    """also: columns of docs that come along, as fields of a column `also`."""
    extra = [F.struct(*also).alias("also")] if also else []
    whole = docs.select(F.col(doc).alias("doc"), F.xxhash64(doc, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)
    joined = whole.join(drops, "row", "left").select("doc", "text", "drops", *(["also"] if also else []))
    # Only texts that lose lines pay for splitting and hashing once more.
    cut = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), keys(F.col("text")).alias("key")), lambda x: ~F.array_contains(F.col("drops"), F.xxhash64(x["key"])))
    lines = F.when(F.col("drops").isNull(), F.split("text", "\n")).otherwise(F.transform(cut, lambda x: x["line"]))
    return joined.select(
        F.col("doc"),
        *(["also"] if also else []),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        common.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.array_join(x, "\n").alias("kept"))).alias("x"),
    ).select("doc", *(["also"] if also else []), "n_lines", (F.col("n_lines") - F.col("x.n")).alias("n_dropped"), F.col("x.kept").alias("kept"))


def frequent_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc, n_lines, n_dropped, kept) for every row: lines whose key at least min_docs documents hold are gone.

    The lines' hashes are written once, cut into batches; batch after batch is admitted to the runs, and a last join of
    all lines with the frequent keys finds those to drop.
    """
    spark = docs.sparkSession
    path = common.scratch_path(spark, "line-hashes")
    hashes = line_hashes(docs, text, doc, min_chars).withColumn("batch", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(batches)).cast("int"))
    schema = hashes.schema
    hashes.write.partitionBy("batch").parquet(path)
    lines, runs = spark.read.schema(schema).parquet(path), LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(runs.batch(lines.where(F.col("batch") == b)))
    frequent = runs.frequent(min_docs)
    runs.close()
    common.release(spark)
    return dropped(docs, row_drops(lines, frequent), text, doc, also)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frequent_lines(common.table(spark, sf_dir, "documents"))
    return kept.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, hot.key IS NOT NULL AS gone FROM keyed LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
