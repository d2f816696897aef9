"""Point writes from a stream: each micro-batch is summed by place and merged into a versioned Parquet tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StreamedTensor:
    """Sums of a stream of (i0.., v) rows.

    Every batch writes its own sums under its number, so a batch that is run again after a failure replaces itself and is counted
    once. Reading sums the batches' files.
    """

    def __init__(self, spark: SparkSession, path: str, order: int):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), [f"i{k}" for k in range(order)]

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        def merge(batch: DataFrame, number: int) -> None:
            batch.groupBy(*self.keys).agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy(*self.keys).agg(F.sum("v").alias("v"))


def windowed(stream: DataFrame, time: str, late: str, window: str, *keys: str) -> DataFrame:
    """Sums of v by window and keys, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.sum("v").alias("v"))
