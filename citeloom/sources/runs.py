"""Runs whose outputs become visible together.

A run writes each of its outputs to a folder of its own, ``<part>/run=<id>``, and
then one line in ``manifest/run=<id>``. Readers only see the runs of the manifest,
so what a broken run left is not there for them, and the repeated run, of the same
id, writes it anew. A run that is in the manifest is never written again.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.schemas import ARTICLE, HISTORY
from citeloom.sources.articles import duplicates_path

# The outputs of a metadata run.
ARTICLES, DUPLICATES, HISTORIES = "articles", "duplicates", "history"
_MANIFEST = "destination string, run string"


def _table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def committed_runs(spark: SparkSession, base: str) -> DataFrame:
    """``destination, run`` of every run that is complete."""
    return _table(spark, f"{base}/manifest", _MANIFEST, "json").where("destination IS NOT NULL")


def commit_run(
    spark: SparkSession, base: str, run_id: str, destination: str, outputs: dict[str, DataFrame]
) -> bool:
    """Write all outputs of a run, then make them visible; False if the run is complete already.

    A destination that another run has written to is refused. There has to be one
    writer for a destination at a time, as the stream of requests makes sure.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"not fit for the name of a folder: {run_id!r}")
    runs = committed_runs(spark, base)
    held = runs.where((F.col("run") == run_id) | (F.col("destination") == destination)).collect()
    if any(r["run"] == run_id for r in held):
        return False
    if held:
        raise FileExistsError(f"{destination} already exists, from run {held[0]['run']}")
    for part, rows in outputs.items():
        rows.write.mode("overwrite").parquet(f"{base}/{part}/run={run_id}")
    note = spark.createDataFrame([(destination,)], "destination string").coalesce(1)
    # One file, put in place in one step; of an attempt that broke off before, nothing is kept.
    note.write.mode("overwrite").json(f"{base}/manifest/run={run_id}")
    return True


def read_runs(spark: SparkSession, base: str, part: str, schema: T.StructType) -> DataFrame:
    """Rows of an output, of all complete runs, with their ``run`` and ``destination``."""
    names = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    # Only the folders of complete runs are read: their names are the join's key.
    return _table(spark, f"{base}/{part}", names, "parquet").join(committed_runs(spark, base), "run")


def read_committed_articles(spark: SparkSession, base: str) -> DataFrame:
    """Articles and repeats of all complete runs, by the ``file_name`` of their collection."""

    def named(part: str, name: Column) -> DataFrame:
        rows = read_runs(spark, base, part, ARTICLE)
        return rows.select(*ARTICLE.fieldNames(), F.substring_index(name, "/", -1).alias("file_name"))

    # The suffix goes, as beside a collection.
    stem = F.regexp_replace(F.substring_index("destination", "/", -1), r"(?<=[^.])\.[^.]*\z", "")
    repeats = F.concat(stem, F.lit(duplicates_path("")))
    return named(ARTICLES, F.col("destination")).unionByName(named(DUPLICATES, repeats))


def read_history(spark: SparkSession, base: str) -> DataFrame:
    """History rows of all complete runs."""
    return read_runs(spark, base, HISTORIES, HISTORY).select(*HISTORY.fieldNames())
