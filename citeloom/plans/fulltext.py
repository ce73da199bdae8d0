"""The full-text run: what to fetch or convert, and the updated records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators.fulltext import fetch_plan, update_fulltext
from citeloom.sources.files import file_inventory


class FulltextRun(NamedTuple):
    plan: DataFrame
    updated: DataFrame


def fulltext_run(
    spark: SparkSession,
    articles: DataFrame,
    pdf_dir: str,
    html_dir: str,
    pdf_base: str,
    html_base: str,
) -> FulltextRun:
    """Plan from the files present now; the update is written once, as a set."""
    pdfs = file_inventory(spark, pdf_dir, ".pdf")
    htmls = file_inventory(spark, html_dir, ".html")
    return FulltextRun(
        fetch_plan(articles, pdfs, htmls), update_fulltext(articles, pdfs, pdf_base, html_base)
    )
