"""Shared plumbing of the corpus operators: tables, shared scratch space and the white-space set."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words and surround lines.
WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on a single machine (which is then set for the session), and an error on a cluster, whose executors wouldn't see it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    drop_shuffles: the shuffle files of the write go as it ends. release() leaves that to the driver's garbage collection, and just
    after a write the plan is often still held, so that they stay.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    try:
        if drop_shuffles:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if drop_shuffles and before is None:
            spark.conf.unset(_CLEANUP)
        elif drop_shuffles:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


#: What materialise() has written and discard() may delete.
_paths: dict[int, tuple[DataFrame, str]] = {}


def discard(*written: DataFrame) -> None:
    """Delete what materialise() wrote for these, once nothing that is still to run reads it; and let Spark drop the shuffle files of finished jobs."""
    for df in written:
        _, path = _paths.pop(id(df), (df, None))
        if path:
            remove(df.sparkSession, path)
    release(written[0].sparkSession)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable isn't inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but the six ASCII white-space characters; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))
