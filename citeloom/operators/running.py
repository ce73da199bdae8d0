"""Running totals over a whole table without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block, and the fewest bounds between blocks.
BLOCK_ROWS = 100_000
LEAST_BOUNDS = 256


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to this one, in ``order``.

    ``order`` is unique. Rows fall into blocks between bounds, about one in
    ``BLOCK_ROWS`` rows, which are picked by hash so that they are the same in
    every run. Each block is summed on its own; only one row per block meets in
    one task.
    """
    bounds_wanted = max(LEAST_BOUNDS, df.count() // BLOCK_ROWS)
    picked = df.select(order).orderBy(F.xxhash64(order), order).limit(bounds_wanted)
    bounds = picked.agg(F.array_sort(F.collect_list(order)).alias("_bounds"))
    blocked = (
        df.withColumn("_bounds", bounds.scalar())
        .withColumn("_block", F.size(F.filter("_bounds", lambda b: b <= F.col(order))))
        .drop("_bounds")
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("_block")
        .agg(F.sum(value).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_block").orderBy(order)
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, "_block")
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_inside", "_offset")
    )
