"""Queries over bucket events and paths, in batch and as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.bindings import tables as t
from citeloom.bindings.texts import REJECTS_SQL, REQUESTS_SQL
from citeloom.functions import paths as p
from citeloom.functions.status import DEFAULT_PLACES, MESSAGES, fill_places
from citeloom.operators.configs import checked_configs, config_stages, split_checked
from citeloom.operators.events import (
    conversion_stages,
    created_only,
    created_paths,
    event_counts,
    event_records,
    project_stages,
    routed,
    run_stages,
    status_rows,
    watch_filter,
)
from citeloom.sources.configs import parse_configs
from citeloom.sources.files import bucket_events
from citeloom.storage import shared_dir
from citeloom.streaming import jobs


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return event_records(t.notifications(spark, sf))


_RECORDS = f"WITH {t.EVENTS} SELECT time, event_type, bucket_name, object_key FROM records"


def q_created_only(spark: SparkSession, sf: str) -> DataFrame:
    return created_only(_records(spark, sf))


_CREATED = f"WITH {t.EVENTS} SELECT time, event_type, bucket_name, object_key FROM created"


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return routed(created_paths(t.notifications(spark, sf), t.ROOT), t.ROOT)


def q_route_path(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("path", "project", "route")


_ROUTED = f"WITH {t.EVENTS} SELECT path, project, route FROM routed"


def q_project_dirs(spark: SparkSession, sf: str) -> DataFrame:
    created = created_paths(t.notifications(spark, sf), t.ROOT)
    return created.select("path", p.project_dirs(t.ROOT, F.col("path")).alias("d")).select("path", "d.*")


_DIRS = f"""WITH {t.EVENTS}
SELECT path, '{t.ROOT}/' || project || '/config' AS config,
       '{t.ROOT}/' || project || '/metadata' AS metadata,
       '{t.ROOT}/' || project || '/html' AS html, '{t.ROOT}/' || project || '/pdf' AS pdf
FROM routed"""


def q_derive_targets(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return created_paths(t.notifications(spark, sf), t.ROOT).select(
        "path",
        p.config_log_path(path).alias("config_log"),
        p.bib_log_path(path).alias("bib_log"),
        p.destination_path(t.ROOT, path).alias("destination"),
        p.pdf_log_path(t.ROOT, path).alias("pdf_log"),
        p.html_name(p.base_name(path)).alias("html_name"),
        p.html_path(path).alias("html_path"),
    )


_TARGETS = f"""WITH {t.EVENTS},
named AS (SELECT *, string_split(path, '/')[-1] AS name FROM routed)
SELECT path,
  replace(replace(replace(replace(path, '.json', '.log'), '.yaml', '.log'), '.bib', '.log'),
          'config', 'log') AS config_log,
  replace(replace(path, '.bib', '.log'), 'config', 'log') AS bib_log,
  CASE WHEN suffix(path, '.json') OR suffix(path, 'bib')
       THEN '{t.ROOT}/' || project || '/metadata/' || replace(name, '.bib', '.json') END AS destination,
  '{t.ROOT}/' || project || '/log/' || replace(name, '.pdf', '.log') AS pdf_log,
  replace(name, '.pdf', '.html') AS html_name,
  replace(path, 'pdf', 'html') AS html_path
FROM named"""


def q_watch_filter(spark: SparkSession, sf: str) -> DataFrame:
    return watch_filter(created_paths(t.notifications(spark, sf), t.ROOT)).select("path")


_WATCHED = rf"""WITH {t.EVENTS}
SELECT path FROM routed WHERE regexp_matches(path, '(?i)\.(json|pdf|bib|yaml|yml)')"""


def q_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return event_counts(q_created_only(spark, sf), ["bucket_name"])


_COUNTS = f"WITH {t.EVENTS} SELECT bucket_name, count(*) AS events FROM created GROUP BY bucket_name"


def q_status_messages(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.status_stream(_routed(spark, sf))


_STATUS = f"""WITH {t.EVENTS}
SELECT time, project,
       CASE route WHEN 'pdf' THEN 'pdf_received' ELSE 'config_received' END AS stage,
       project || CASE route WHEN 'pdf' THEN ': 系统已获取到新的文献PDF。正在转换为HTML，请稍后。'
                             ELSE ': 收到新的检索式，正在处理。' END AS message,
       CAST(NULL AS VARCHAR) AS reason
FROM routed WHERE route <> 'ignored'"""


def q_status_flow(spark: SparkSession, sf: str) -> DataFrame:
    """All that is told about projects, configs, runs and conversions."""
    events = _routed(spark, sf)
    folders = t.table(spark, sf, "events").select(
        F.concat(F.lit(f"{t.ROOT}/p"), F.col("user_id") % 5).alias("path")
    )
    checked = checked_configs(
        parse_configs(t.config_texts(spark, sf)), t.metadata_files(spark, sf), t.ROOT
    )
    runs = split_checked(checked)[0].select(
        "project",
        "path",
        "download_pdf",
        F.when(F.length("path") % 5 == 0, "no answer").alias("error"),
        F.when(F.length("query_str") % 3 == 0, "time is up").alias("pdf_error"),
    )
    htmls = t.table(spark, sf, "events").where("value < 5")
    htmls = htmls.select(
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("project"),
        F.concat("event_id", F.lit(".html")).alias("name"),
    )
    told = [
        project_stages(folders.distinct(), t.ROOT),
        config_stages(checked),
        run_stages(runs),
        conversion_stages(events, htmls),
    ]
    rows = reduce(DataFrame.unionAll, [x.select("project", "stage", "reason") for x in told])
    return status_rows(rows, F.lit("now"))


_TEXTS = ", ".join(
    "('" + stage + "', '" + fill_places(text, DEFAULT_PLACES).replace("\n", "' || chr(10) || '") + "')"
    for stage, text in MESSAGES.items()
)
_FLOW = f"""WITH {t.EVENTS}, {t.CONFIGS},
runs AS (
  SELECT project, download_pdf, CASE WHEN len(path) % 5 = 0 THEN 'no answer' END AS error,
         CASE WHEN len(query_str) % 3 = 0 THEN 'time is up' END AS pdf_error
  FROM checked WHERE reason IS NULL),
told AS (
  SELECT DISTINCT 'p' || (user_id % 5) AS project, 'project_created' AS stage, NULL AS reason FROM events
  UNION ALL
  SELECT project, unnest(CASE reason WHEN 'config_missing' THEN ['config_missing']
                     WHEN 'config_bad_format' THEN ['config_bad_format', 'config_unreadable']
                     WHEN 'config_unreadable' THEN ['config_bad_format']
                     WHEN 'destination_exists' THEN ['config_received', 'destination_exists']
                     WHEN 'empty_query' THEN ['config_received', 'config_parsed', 'failed']
                     ELSE ['config_received', 'config_parsed'] END), reason FROM checked
  UNION ALL SELECT project, 'failed', error FROM runs WHERE error IS NOT NULL
  UNION ALL SELECT project, 'query_done', NULL FROM runs WHERE error IS NULL
  UNION ALL SELECT project, 'metadata_ready', NULL FROM runs WHERE error IS NULL AND download_pdf
  UNION ALL SELECT project, CASE WHEN pdf_error IS NULL THEN 'pdf_downloaded' ELSE 'failed' END, pdf_error
  FROM runs WHERE error IS NULL AND download_pdf
  UNION ALL SELECT project, 'pdf_received', NULL FROM routed WHERE route = 'pdf'
  UNION ALL SELECT project, 'pdf_converted', NULL FROM routed
  WHERE route = 'pdf' AND replace(string_split(path, '/')[-1], '.pdf', '.html') IN
        (SELECT event_id || '.html' FROM events WHERE value < 5)),
texts AS (SELECT * FROM (VALUES {_TEXTS}) AS v(stage, text))
SELECT 'now' AS time, project, stage,
       replace(replace(text, '{{project}}', project), '{{error}}', coalesce(reason, '')) AS message,
       reason
FROM told JOIN texts USING (stage)"""


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files.

    Written as a pattern, as a stream takes a plain path for a folder only.
    """
    schema = t.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def _notification_stream(spark: SparkSession, sf: str) -> DataFrame:
    return t.notification_columns(_table_stream(spark, sf, "events"))


def _appended(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    base = shared_dir(spark, label)
    jobs.append_sink(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def q_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    routes = jobs.event_stream(_notification_stream(spark, sf), t.ROOT)
    return _appended(routes.select("path", "project", "route"), "events")


def q_bucket_events(spark: SparkSession, sf: str) -> DataFrame:
    """Notifications written as JSON files and taken up by the file stream."""
    base = shared_dir(spark, "notifications")
    t.notifications(spark, sf).select("Records").write.json(base)
    return _appended(created_paths(bucket_events(spark, base), t.ROOT).select("path"), "bucket")


_PATHS = f"WITH {t.EVENTS} SELECT path FROM routed"


def q_file_stream(spark: SparkSession, sf: str) -> DataFrame:
    paths = created_paths(_notification_stream(spark, sf), t.ROOT).select("path")
    return _appended(jobs.file_stream(paths, t.ROOT), "files")


_FILES = rf"""WITH {t.EVENTS}
SELECT path, project, route FROM routed WHERE regexp_matches(path, '(?i)\.(json|pdf|bib|yaml|yml)')"""


def q_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    routes = jobs.event_stream(_notification_stream(spark, sf), t.ROOT)
    return _appended(jobs.status_stream(routes), "status")


def _config_stream(spark: SparkSession, sf: str, part: str) -> DataFrame:
    base = shared_dir(spark, "configs")
    texts = t.config_columns(_table_stream(spark, sf, "documents"))
    jobs.config_stream(
        texts, lambda: t.metadata_files(spark, sf), t.ROOT, base, f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/{part}").drop("batch")


def q_config_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _config_stream(spark, sf, "requests")


def q_config_stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _config_stream(spark, sf, "rejects")


def q_config_claims_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Configs for the same destinations in two batches, the stream stopped in between."""
    base = shared_dir(spark, "claims")
    configs = t.source_configs(spark, sf).withColumn("path", F.concat(F.lit(f"{t.ROOT}/"), "path"))
    early = F.col("path").rlike(r"\.(yaml|txt)\z")
    for part in (configs.where(early), configs.where(~early)):
        part.write.mode("append").parquet(f"{base}/in")
        texts = spark.readStream.schema("path string, value string").parquet(f"{base}/in")
        none = spark.createDataFrame([], "path string")
        jobs.config_stream(texts, lambda: none, t.ROOT, base, f"{base}/checkpoint").awaitTermination()
    requests, rejects = (spark.read.parquet(f"{base}/{x}") for x in ("requests", "rejects"))
    reason = F.lit(None).cast("string").alias("reason")
    return requests.select("path", reason).unionByName(rejects.select("path", "reason"))


_CLAIMS = f"""WITH {t.SOURCE_CONFIGS}
SELECT '{t.ROOT}/' || path AS path,
       CASE WHEN suffix IN ('.yml', '.txt') THEN 'config_bad_format' WHEN NOT readable THEN 'config_unreadable'
            WHEN suffix <> '.yaml' THEN 'destination_exists' END AS reason
FROM source_configs"""


def _project_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every purchase has a PDF, those of a low value their HTML too.

    The files lie in seven projects, of which the events touch five.
    """
    bought = t.table(spark, sf, "events").where("event_type = 'purchase'")
    project = F.concat(F.lit("p"), F.col("user_id") % 7).alias("project")
    pdfs = bought.select(project, F.concat("event_id", F.lit(".pdf")).alias("name"))
    htmls = bought.where("value < 5").select(
        project, F.concat("event_id", F.lit(".html")).alias("name")
    )
    return pdfs, htmls


def q_conversion_stream(spark: SparkSession, sf: str) -> DataFrame:
    """New PDFs start a scan of their projects; the others are left alone."""
    base = shared_dir(spark, "conversions")
    routes = jobs.event_stream(_notification_stream(spark, sf), t.ROOT)
    jobs.conversion_stream(
        routes, lambda: _project_files(spark, sf), f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


_CONVERSIONS = f"""WITH {t.EVENTS}
SELECT 'p' || (user_id % 7) AS project, event_id || '.pdf' AS name FROM events
WHERE event_type = 'purchase' AND NOT value < 5
  AND 'p' || (user_id % 7) IN (SELECT project FROM routed WHERE route = 'pdf')"""


QUERIES = {
    "event_records": (_records, _RECORDS),
    "created_only": (q_created_only, _CREATED),
    "route_path": (q_route_path, _ROUTED),
    "project_dirs": (q_project_dirs, _DIRS),
    "derive_targets": (q_derive_targets, _TARGETS),
    "watch_filter": (q_watch_filter, _WATCHED),
    "event_counts": (q_event_counts, _COUNTS),
    "status_messages": (q_status_messages, _STATUS),
    "status_flow": (q_status_flow, _FLOW),
    "event_stream": (q_event_stream, _ROUTED),
    "bucket_events": (q_bucket_events, _PATHS),
    "file_stream": (q_file_stream, _FILES),
    "status_stream": (q_status_stream, _STATUS),
    "config_stream": (q_config_stream, REQUESTS_SQL),
    "config_stream_rejects": (q_config_stream_rejects, REJECTS_SQL),
    "config_claims_stream": (q_config_claims_stream, _CLAIMS),
    "conversion_stream": (q_conversion_stream, _CONVERSIONS),
}
