"""Ranks and running totals over groups of any size, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, bucket: str, order: Sequence[Column], value: str, into: str) -> DataFrame:
    """``df`` with the running total of ``value`` in each ``group``, this row included, as ``into``.

    ``bucket`` cuts a group, in the sense of ``order``, into a bounded number of consecutive runs: rows are summed
    by bucket first, the sums of earlier buckets are joined on, and only one bucket's rows are sorted together.
    ``group`` and ``bucket`` hold no nulls.
    """
    # summed by bucket first and dealt by group after: a group's sums are as many as its buckets, not tasks times buckets
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("__sum")).repartition(F.col(group))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [group, bucket]).withColumn(into, F.col("__start") + F.sum(value).over(inside)).drop("__start")
