"""The metadata run: known ids out, raw articles to records, factors in."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.dedup import duplicated_articles, new_pmids
from citeloom.operators.enrich import project_articles, rejected_articles, with_enrichment
from citeloom.operators.history import run_summary
from citeloom.schemas import HISTORY
from citeloom.sources.articles import append_history, write_articles, write_duplicates
from citeloom.sources.runs import ARTICLES, DUPLICATES, HISTORIES, commit_run
from citeloom.storage import materialized


class MetadataRun(NamedTuple):
    articles: DataFrame
    rejects: DataFrame
    duplicates: DataFrame
    history: DataFrame


def metadata_run(
    incoming: DataFrame,
    raw: DataFrame,
    earlier: DataFrame,
    run_date: str,
    filename: str,
    query_str: str,
    tag: str | None = None,
    enrichment: Callable[[DataFrame], DataFrame] | None = None,
) -> MetadataRun:
    """Plan one run. ``raw`` holds the fetched article of each id.

    An id without one is among the rejects.

    New ids and their raw articles go to the shared folder, as the outputs all
    start from them.
    """
    fresh = materialized(new_pmids(incoming, earlier), "new-ids")
    keyed = fresh.select(F.col("pmid").cast("string").alias("pmid"))
    found = raw.withColumn("_fetched", F.lit(True))
    joined = materialized(keyed.join(found, "pmid", "left"), "fetched")
    fetched = joined.where("_fetched").drop("_fetched")
    lost = joined.where("_fetched IS NULL").drop("_fetched")
    articles = project_articles(fetched, run_date, tag).transform(
        lambda df: with_enrichment(df, enrichment)
    )
    spark = incoming.sparkSession
    runs = spark.createDataFrame([(filename, query_str)], "filename string, query_str string")
    history = run_summary(
        incoming.withColumn("filename", F.lit(filename)),
        fresh.withColumn("filename", F.lit(filename)),
        runs,
        F.lit(run_date),
    )
    rejects = rejected_articles(fetched).unionByName(
        lost.withColumn("reason", F.lit("no article was fetched"))
    )
    return MetadataRun(articles, rejects, duplicated_articles(incoming, earlier), history)


def commit_metadata_run(run: MetadataRun, base: str, destination: str, run_id: str) -> bool:
    """Write records, repeats and the history row as one: all are visible, or none.

    A run that broke off is repeated under its id; one that is complete is left as
    it is, and False. ``read_committed_articles`` and ``read_history`` read them.
    """
    outputs = {
        ARTICLES: run.articles,
        DUPLICATES: run.duplicates,
        HISTORIES: run.history.select(*HISTORY.fieldNames()),
    }
    return commit_run(run.articles.sparkSession, base, run_id, destination, outputs)


def write_metadata_run(run: MetadataRun, destination: str, history_path: str) -> None:
    """Write records, then repeats if any, then the history row, as plain tables.

    An existing destination is refused, as a repeated run would hide it. The three
    are not one commit; ``commit_metadata_run`` is.
    """
    write_articles(run.articles, destination, mode="error")
    write_duplicates(run.duplicates, destination)
    append_history(run.history, history_path)
