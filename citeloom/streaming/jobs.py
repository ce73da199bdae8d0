"""Event-driven steps as streaming queries.

The checkpoint makes sure each file is seen once. Only configs need state: which
destinations are taken. Batches that write go to a folder of their own that is
overwritten, so a batch that is run again after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.functions.paths import config_format
from citeloom.operators.configs import against_existing, config_stages, placed_configs, split_checked
from citeloom.operators.events import (
    created_paths,
    received_stage,
    routed,
    status_rows,
    watch_filter,
)
from citeloom.operators.fulltext import pending_conversions
from citeloom.plans.access import snapshot_plan
from citeloom.sources.configs import CONFIG_GLOB, parse_configs
from citeloom.sources.files import bucket_events, new_files, new_texts

Trigger = dict[str, object]
ONCE: Trigger = {"availableNow": True}
# One small row per plan that was written, beside the plans.
_POINTER = "snapshot bigint, folder string"


def event_stream(notifications: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Routed paths of new objects, from a stream of notifications."""
    return routed(created_paths(notifications, root), root, strict)


def bucket_event_stream(spark: SparkSession, folder: str, root: str) -> DataFrame:
    return event_stream(bucket_events(spark, folder), root)


def file_stream(paths: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Routed paths of the new files that are watched for."""
    return routed(watch_filter(paths, strict), root, strict)


def folder_stream(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The same for a folder; ``root`` is the folder as file paths show it."""
    return file_stream(new_files(spark, folder), root)


def status_stream(events: DataFrame, time: str = "time") -> DataFrame:
    """Status rows of routed events that somebody acts on.

    A config of a bad format is told twice, as the batch form does; what becomes
    of the others is told by the steps that know it.
    """
    stage = received_stage(F.col("route"), config_format(F.col("path")))
    told = F.when(
        stage == "config_bad_format", F.array(stage, F.lit("config_unreadable"))
    ).otherwise(F.array(stage))
    stages = events.withColumn("stage", F.explode(told)).where("stage is not null")
    return status_rows(stages.withColumn("reason", F.lit(None).cast("string")), F.col(time))


def append_sink(
    stream: DataFrame, out: str, checkpoint: str, trigger: Trigger | None = None
) -> StreamingQuery:
    """Append a stream to a parquet table."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def _batch_sink(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Trigger | None,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def claimed_stream(placed: DataFrame) -> DataFrame:
    """Of the configs for one destination, let the first run and refuse the others.

    The state holds the path that took a destination, in this batch or any before,
    also across restarts; within a batch, configs come in the order of their paths.
    """
    # Rows without a destination take nothing; they share a few keys, as each key has its cost.
    nowhere = F.concat(F.lit("\0"), F.pmod(F.hash("path"), F.lit(1000)))
    keyed = placed.withColumn("_key", F.coalesce("destination", nowhere))

    # Defined here so that it travels to the executors by value.
    def claim(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.exists
        parts = list(frames)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        # Most destinations have one config; little is done for it.
        if len(rows) > 1:
            rows = rows.sort_values("path", kind="stable")
        del rows["_key"]
        reasons, changed = [], False
        for reason, destination in zip(rows["reason"], rows["destination"], strict=True):
            reason = None if pd.isna(reason) else reason
            if taken and reason in (None, "empty_query"):
                reason, changed = "destination_exists", True
            elif reason is None and not pd.isna(destination):
                taken = True
            reasons.append(reason)
        if taken and not state.exists:
            state.update((rows["path"].iloc[reasons.index(None)],))
        if changed:
            rows["reason"] = pd.Series(reasons, index=rows.index, dtype=object)
        yield rows

    return keyed.groupBy("_key").applyInPandasWithState(
        claim, placed.schema, "holder string", "append", GroupStateTimeout.NoTimeout
    )


def config_stream(
    texts: DataFrame,
    existing: Callable[[], DataFrame],
    root: str,
    out: str,
    checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """Turn new config files into requests and rejects.

    ``texts`` streams ``(path, value)``; ``existing`` lists the metadata files
    at the time of each batch. A destination that a request was made for is taken
    from then on, before its file is there. Results go to ``out/requests``,
    ``out/rejects`` and, as messages to the users, ``out/status``.
    """
    found = routed(texts, root).where("route = 'config'").drop("project", "route")
    placed = placed_configs(parse_configs(found), root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = against_existing(batch, existing()).persist()
        try:
            requests, rejects = split_checked(checked)
            status = status_rows(config_stages(checked), F.current_timestamp())
            for name, rows in (("requests", requests), ("rejects", rejects), ("status", status)):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            checked.unpersist()

    return _batch_sink(claimed_stream(placed), handle, checkpoint, trigger)


def config_folder_stream(
    spark: SparkSession,
    folder: str,
    existing: Callable[[], DataFrame],
    root: str,
    out: str,
    checkpoint: str,
    trigger: Trigger | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """The same for a folder; only files with a config's suffix are opened."""
    texts = new_texts(spark, folder, CONFIG_GLOB, files_per_trigger)
    return config_stream(texts, existing, root, out, checkpoint, trigger)


def conversion_stream(
    events: DataFrame,
    inventories: Callable[[], tuple[DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    trigger: Trigger | None = None,
) -> StreamingQuery:
    """On new PDFs, list all PDFs of their projects that lack HTML.

    ``inventories`` gives the PDF and HTML files with ``project`` and ``name``
    at the time of each batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = batch.where("route = 'pdf'").select("project").distinct()
        pdfs, htmls = inventories()
        asked = pdfs.join(touched, "project", "left_semi")
        pending = pending_conversions(asked, htmls, by=["project"])
        pending.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _batch_sink(events, handle, checkpoint, trigger)


def access_refresh(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    minutes: float | None = None,
) -> StreamingQuery:
    """Recompute the account plan when snapshot files arrive.

    Snapshots lie in ``folder/snapshot=<number>``, numbers growing with time. Of
    the snapshots a batch brings, the latest is planned, from all of its files,
    into ``out/snapshot=<number>``; readers take the highest number.
    """
    trigger: Trigger = ONCE if minutes is None else {"processingTime": f"{minutes} minutes"}
    number = F.regexp_extract("path", r"/snapshot=(\d+)/", 1)
    snapshot = F.struct(number.try_cast("bigint").alias("order"), number.alias("number"))
    files = new_files(spark, folder).select(snapshot.alias("snapshot"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest = batch.agg(F.max("snapshot")["number"]).first()[0]
        if latest:
            plan = snapshot_plan(spark, f"{folder}/snapshot={latest}")
            plan.write.mode("overwrite").parquet(f"{out}/snapshot={latest}")
            note = spark.createDataFrame([(int(latest), latest)], _POINTER)
            note.write.mode("append").json(f"{out}/_latest")

    return _batch_sink(files, handle, checkpoint, trigger)


def latest_plan(spark: SparkSession, out: str) -> DataFrame:
    """The plan of the highest snapshot; the others are not opened."""
    notes = spark.read.schema(_POINTER).json(f"{out}/_latest")
    number = notes.agg(F.max(F.struct("snapshot", "folder"))["folder"]).first()[0]
    plan = spark.read.parquet(f"{out}/snapshot={number}")
    return plan.withColumn("snapshot", F.lit(int(number)))
