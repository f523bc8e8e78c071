"""Usage events and page results as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_table import BUCKETS, BucketTable


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events (used_at, kind, amount) per window and kind. On a stream, events later than the watermark are dropped and
    windows come out once it has passed them; on a table, it is the plain aggregate."""
    stream = events.withColumn("used_at", F.col("used_at").cast("timestamp"))
    if events.isStreaming:
        stream = stream.withWatermark("used_at", late)
    return stream.groupBy(F.window("used_at", width), "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.col("window.start").alias("start"), "kind", "n", "amount")


def slot_sink(path: str, keys: list[str], keep: int = 2, buckets: int = BUCKETS):
    """A foreachBatch function that keeps in a table, for each slot, the result of the greatest seq: pages may answer in any order, within a batch
    or across, and a late older answer changes nothing; nor does a replayed batch. A batch rewrites the buckets it touches."""
    return lambda batch, batch_id: BucketTable(batch.sparkSession, path, keys, buckets, keep).merge(batch, batch_id)


def versions(spark, path: str) -> list[int]:
    return BucketTable(spark, path, []).versions()


def current(spark, path: str) -> DataFrame | None:
    """The table's latest version, if there is one."""
    return BucketTable(spark, path, []).read()
