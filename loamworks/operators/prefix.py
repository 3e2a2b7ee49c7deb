"""Running totals and ranks that no single task has to compute.

A window without a partition key, or with a hot one, sorts everything in one task. Here the
rows of a group are first split into ordered buckets; only one row per bucket meets the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.session import materialize, shuffle_partitions


def running_total(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], value: Column, out: str
) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows before this one in its group.

    ``bucket`` must rise with ``order``: all rows of a lower bucket come first. ``order`` must be
    unique within a bucket. Rows whose value is null count as zero. An empty input gives an empty result.
    """
    keys = [*group, bucket]
    value = F.coalesce(value, F.lit(0))
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (
        local.join(offsets, on)
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside", *[f"_k{i}" for i in range(len(keys))])
    )


def ranged(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and add the partition's number as ``_range``, rising with the order.

    The result is materialized, since range bounds come from a sample and must not change afterwards.
    """
    n = parts or shuffle_partitions(df.sparkSession)
    return materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def running_total_by_order(
    df: DataFrame, order: Sequence[str], value: Column, out: str, group: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """``running_total`` for any unique order, by way of ``ranged``."""
    split = ranged(df, [*group, *order], parts)
    return running_total(split, group, "_range", list(order), value, out).drop("_range")
