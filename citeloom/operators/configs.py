"""Checks on query configs before they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.paths import (
    base_name,
    config_format,
    destination_path,
    project_dir,
    project_name,
)
from citeloom.functions.text import normalize_query
from citeloom.operators.enrich import DEFAULT_TAG


def placed_configs(configs: DataFrame, root: str) -> DataFrame:
    """Add project, format, destination and ``reason``, by each config alone.

    ``configs`` has ``path``, ``readable`` and the config fields. The reason is
    null if nothing in the config itself speaks against running it.
    """
    path = F.col("path")
    placed = F.concat(project_dir(root, path, "config"), F.lit("/"), base_name(path)) == path
    reason = (
        F.when(~F.coalesce(placed, F.lit(False)), "config_missing")
        .when(F.col("format") == "invalid", "config_bad_format")
        .when(~F.col("readable"), "config_unreadable")
        .when(F.coalesce("query_str", F.lit("")) == "", "empty_query")
    )
    return (
        configs.withColumn("project", project_name(root, path))
        .withColumn("format", config_format(path))
        .withColumn("destination", destination_path(root, path))
        .withColumn("reason", reason)
    )


def refused(reason: Column, taken: Column) -> Column:
    """The reason, once it is known whether the destination is taken.

    An empty query is only found out when the config would run, so it gives way.
    """
    open_ = reason.isNull() | (reason == "empty_query")
    return F.when(open_ & taken, "destination_exists").otherwise(reason)


def against_existing(placed: DataFrame, existing: DataFrame) -> DataFrame:
    """Refuse the configs whose destination is among the ``path`` of ``existing``."""
    there = existing.select(F.col("path").alias("destination"), F.lit(True).alias("_taken"))
    joined = placed.join(there.distinct(), "destination", "left")
    return joined.withColumn("reason", refused(F.col("reason"), F.col("_taken").isNotNull())).drop("_taken")


def claimed_in_turn(placed: DataFrame) -> DataFrame:
    """Refuse the configs whose destination one before them takes.

    Configs come in the order of their paths. One that may run takes its
    destination, so each destination gets one request. Configs without one are
    spread by their paths.
    """
    turn = Window.partitionBy(F.coalesce("destination", "path")).orderBy("path", "query_str", "author", "download_pdf")
    before = F.max(F.col("reason").isNull()).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    taken = F.coalesce(before, F.lit(False)) & F.col("destination").isNotNull()
    return placed.withColumn("_before", taken).withColumn("reason", refused(F.col("reason"), F.col("_before"))).drop("_before")


def checked_configs(configs: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Add project, format, destination and ``reason`` (null if it may run).

    ``existing`` has the ``path`` of the metadata files there already. Of several
    configs for one destination (``q.json`` and ``q.yaml``) the first runs.
    """
    return claimed_in_turn(against_existing(placed_configs(configs, root), existing))


def validate_configs(
    configs: DataFrame, existing: DataFrame, root: str
) -> tuple[DataFrame, DataFrame]:
    """Split configs into requests that may run, and rejects with a reason."""
    return split_checked(checked_configs(configs, existing, root))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    requests = checked.where("reason is null").select(
        "project",
        "path",
        "destination",
        normalize_query(F.col("query_str")).alias("query_str"),
        F.coalesce(F.nullif("author", F.lit("")), F.lit(DEFAULT_TAG)).alias("author"),
        F.coalesce("download_pdf", F.lit(False)).alias("download_pdf"),
    )
    rejects = checked.where("reason is not null").select("project", "path", "reason")
    return requests, rejects


# Stages a config goes through, by the reason it was rejected for.
_STAGES = {
    "config_missing": ("config_missing",),
    "config_bad_format": ("config_bad_format", "config_unreadable"),
    "config_unreadable": ("config_bad_format",),
    "destination_exists": ("config_received", "destination_exists"),
    "empty_query": ("config_received", "config_parsed", "failed"),
}


def config_stages(checked: DataFrame) -> DataFrame:
    """One row per stage of each checked config, numbered in order."""
    stages = F.array(F.lit("config_received"), F.lit("config_parsed"))
    for reason, names in _STAGES.items():
        told = F.array(*[F.lit(n) for n in names])
        stages = F.when(F.col("reason") == reason, told).otherwise(stages)
    return checked.select("project", "path", "reason", F.posexplode(stages).alias("step", "stage"))
