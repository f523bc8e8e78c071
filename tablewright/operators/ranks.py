"""Places in an order of any length, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """rows with each row's place, from 1, in the order of its group (keys).

    The rows are dealt by ranges of (keys, order) and sorted within, so a group of any size is spread over as many tasks as its share of the rows;
    written so, each row's partition and number are settled. A place is the row's number within its partition's part of the group, plus the sizes of the
    group's parts in the partitions before: a sum over one row per group and partition. Rows that the order leaves equal get different places.
    """
    spread = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    settled = spread.sortWithinPartitions(*keys, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    held = written(settled, "ranks")
    sizes = held.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], F.col("_part").alias("_in"), (before - F.col("_first") + 1).alias("_shift"))
    on = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return held.join(starts, on).select(*rows.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(name))
