"""Summary of search runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_summary(hits: DataFrame, kept: DataFrame, runs: DataFrame, time: Column) -> DataFrame:
    """History row of each run that found anything.

    ``hits`` and ``kept`` have one row per id with its ``filename``; ``runs``
    has one row per ``filename`` with its ``query_str``. Valid articles are the
    ids left after removing known ones, before any record failed.
    """
    total = hits.groupBy("filename").agg(F.count(F.lit(1)).alias("total_articles"))
    valid = kept.groupBy("filename").agg(F.count(F.lit(1)).alias("_valid"))
    left = F.coalesce("_valid", F.lit(0))
    return (
        total.join(valid, "filename", "left")
        .join(runs.select("filename", "query_str"), "filename")
        .where("total_articles > 0")
        .select(
            time.cast("string").alias("time"),
            "query_str",
            "total_articles",
            (F.col("total_articles") - left).alias("duplicated_articles"),
            left.alias("valid_articles"),
            "filename",
        )
    )
