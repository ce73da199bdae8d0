"""A join whose hot keys are spread by hand, for sessions without adaptive execution.

Spark splits the large partitions of a skewed join at run time, and the other
operators leave it to that. Where adaptive execution is off, the rows of a hot
key can be spread over several salts here, with the lookup row of that key
repeated once per salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BUCKETS = 131_072
MAX_SALTS = 4_096


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with too many rows for one task, and how many salts each gets.

    Too many is more than ``hot_rows`` and more than four times the rows of an
    average bucket; no more than a quarter of the buckets can hold such a key,
    so the result is always small enough to broadcast. Rows are first counted
    by the key's bucket, which shuffles little; only rows of overfull buckets
    are then counted by key, and often there are none.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    bucketed = rows.select(*keys, bucket.alias("_bucket"))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())  # over one row per bucket
    overfull = (
        sizes.withColumn("_limit", F.greatest(F.lit(hot_rows), F.ceil(total * 4 / BUCKETS)))
        .where("_n > _limit")
        .select("_bucket", "_limit")
    )
    return (
        bucketed.join(F.broadcast(overfull), "_bucket")
        .groupBy(*keys, "_limit")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > _limit")
        .select(
            *keys,
            F.least(F.ceil(F.col("_n") / F.col("_limit")), F.lit(MAX_SALTS)).cast("int").alias("_salts"),
        )
    )


def _with_salts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_salts")
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    )
    joined = df.join(F.broadcast(renamed), match, "left")
    return joined.drop(*[f"_hot_{k}" for k in keys])


def split_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    hot_rows: int = HOT_ROWS,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that is unique on ``keys``, hot keys spread over salts.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Hot keys are
    looked for in ``count_in``, by default the rows themselves.

    The salt is the number of the task that reads the row: it is the same again
    when a lost task is run a second time.
    """
    hot = hot_keys(rows if count_in is None else count_in, keys, hot_rows)
    salted_rows = (
        _with_salts(rows, hot, keys)
        .withColumn("_salt", F.coalesce(F.pmod(F.spark_partition_id(), F.col("_salts")), F.lit(0)))
        .drop("_salts")
    )
    salted_lookup = (
        _with_salts(lookup, hot, keys)
        .withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
        )
        .drop("_salts")
    )
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")
