"""Bucket notifications and file events, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.paths import (
    base_name,
    is_watched,
    object_path,
    project_name,
    route_path,
)
from citeloom.functions.status import status_message


def event_records(notifications: DataFrame) -> DataFrame:
    """One row per record of a notification; missing fields are empty."""
    carried = [c for c in notifications.columns if c != "Records"]

    def text(field: str) -> Column:
        return F.coalesce(F.col(field), F.lit(""))

    return notifications.select(*carried, F.explode("Records").alias("_r")).select(
        *carried,
        text("_r.eventName").alias("event_type"),
        text("_r.s3.bucket.name").alias("bucket_name"),
        text("_r.s3.object.key").alias("object_key"),
    )


def created_only(events: DataFrame) -> DataFrame:
    """Events that tell of a new object."""
    return events.where(F.startswith("event_type", F.lit("s3:ObjectCreated")))


def created_paths(notifications: DataFrame, root: str) -> DataFrame:
    """Path of every new object. Keys are used as they come, undecoded."""
    created = created_only(event_records(notifications))
    return created.withColumn("path", object_path(root, F.col("bucket_name"), F.col("object_key")))


def watch_filter(paths: DataFrame, strict: bool = False) -> DataFrame:
    """Files the folder watcher reacts to."""
    return paths.where(is_watched(F.col("path"), strict))


def routed(paths: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Add the project and where the path goes."""
    path = F.col("path")
    return paths.withColumn("project", project_name(root, path)).withColumn(
        "route", route_path(root, path, strict)
    )


def event_counts(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many events there are, as a whole or per group."""
    return events.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("events"))


def status_rows(
    stages: DataFrame, time: Column, places: dict[str, str] | None = None
) -> DataFrame:
    """Status table ``(time, project, stage, message, reason)``.

    ``stages`` has ``project``, ``stage`` and ``reason``.
    """
    message = status_message(F.col("stage"), F.col("project"), F.col("reason"), places)
    return stages.select(
        time.alias("time"), "project", "stage", message.alias("message"), "reason"
    )


def received_stage(route: Column, path_format: Column) -> Column:
    """Stage a routed path starts with; null for paths nobody acts on."""
    return F.when(route == "pdf", "pdf_received").when(
        route == "config",
        F.when(path_format == "invalid", "config_bad_format").otherwise("config_received"),
    )


def _no_reason() -> Column:
    return F.lit(None).cast("string").alias("reason")


def project_stages(folders: DataFrame, root: str) -> DataFrame:
    """Stage of each folder that was created directly below the root: a new project."""
    base = F.lit(root.rstrip("/") + "/")
    name = F.replace("path", base, F.lit(""))
    mine = folders.where(F.startswith("path", base) & (name != "") & ~F.contains(name, F.lit("/")))
    return mine.select(name.alias("project"), "path", F.lit("project_created").alias("stage"), _no_reason())


def run_stages(runs: DataFrame) -> DataFrame:
    """Stages that a request goes through after its config was parsed, numbered in order.

    ``runs`` has ``project``, ``path`` and ``download_pdf`` of the request, and what
    went wrong with its metadata (``error``) or its PDFs (``pdf_error``), or null.
    The query is done even if its PDFs could not be had.
    """

    def told(stage: str, reason: Column | None = None) -> Column:
        return F.struct(F.lit(stage).alias("stage"), _no_reason() if reason is None else reason.alias("reason"))

    pdfs = F.when(F.col("pdf_error").isNull(), told("pdf_downloaded")).otherwise(
        told("failed", F.col("pdf_error"))
    )
    stages = (
        F.when(F.col("error").isNotNull(), F.array(told("failed", F.col("error"))))
        .when(F.col("download_pdf"), F.array(told("metadata_ready"), pdfs, told("query_done")))
        .otherwise(F.array(told("query_done")))
    )
    return runs.select("project", "path", F.posexplode(stages).alias("step", "s")).select(
        "project", "path", "step", "s.stage", "s.reason"
    )


def conversion_stages(events: DataFrame, htmls: DataFrame) -> DataFrame:
    """Stages of new PDFs: received and, if their HTML is there now, converted.

    ``events`` are routed paths; ``htmls`` has ``project`` and ``name``.
    """
    pdfs = events.where("route = 'pdf'").withColumn(
        "name", F.replace(base_name(F.col("path")), F.lit(".pdf"), F.lit(".html"))
    )
    there = htmls.select("project", "name", F.lit(True).alias("_there")).distinct()
    stages = F.when(F.col("_there"), F.array(F.lit("pdf_received"), F.lit("pdf_converted"))).otherwise(
        F.array(F.lit("pdf_received"))
    )
    return pdfs.join(there, ["project", "name"], "left").select(
        "project", "path", F.posexplode(stages).alias("step", "stage"), _no_reason()
    )
