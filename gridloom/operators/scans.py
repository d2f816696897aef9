"""Prefix sums and sorting."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from .tensor import Tensor


def prefix(x: Tensor, exclusive: bool = True, block: int = 1 << 16) -> Tensor:
    """Running sums of a vector. Within blocks of indices by a window, over blocks by a window of their totals, one row a block."""
    rows = x.densify().df.withColumn("block", F.expr(f"i0 div {block}"))
    totals = rows.groupBy("block").agg(F.sum("v").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("block", before.alias("before"))
    frame = W.partitionBy("block").orderBy("i0").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    run = rows.withColumn("run", F.coalesce(F.sum("v").over(frame), F.lit(0)))
    return Tensor(run.join(starts, "block").select("i0", (F.col("before") + F.col("run")).cast(rows.schema["v"].dataType).alias("v")), x.shape, x.dtype, None, False, x.size)


def sort(x: Tensor) -> Tensor:
    """A vector's values in ascending order. Rows are range-partitioned and ordered; an index is the place in the partition plus the rows of those before."""
    # Written once: both uses below must see the same partitions.
    ordered = checkpointed(x.densify().df.select("v").orderBy("v").withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    at = F.row_number().over(W.partitionBy("p").orderBy("m")) - 1
    counts = ordered.groupBy("p").count()
    starts = counts.select(F.col("p").alias("q"), F.coalesce(F.sum("count").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ordered.withColumn("at", at).join(starts, F.col("p") == F.col("q"))
    return Tensor(placed.select((F.col("before") + F.col("at")).cast("bigint").alias("i0"), "v"), x.shape, x.dtype, None, False, x.size)
