"""Which full texts to fetch or convert, and the record update after it.

File inventories have a column ``name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.fulltext import html_object, pdf_markup
from citeloom.functions.paths import html_name


def _pdf_names(files: DataFrame) -> DataFrame:
    return files.where(F.endswith("name", F.lit(".pdf")))


def update_fulltext(
    articles: DataFrame,
    pdfs: DataFrame,
    pdf_base: str,
    html_base: str,
) -> DataFrame:
    """Set the PDF markup where the file exists, and the HTML path always."""
    held = _pdf_names(pdfs).select(F.col("name").alias("_pdf_name"), F.lit(True).alias("_held"))
    named = articles.withColumn("_pdf_name", F.concat(F.col("pmid").cast("string"), F.lit(".pdf")))
    return (
        named.join(held.distinct(), "_pdf_name", "left")
        .withColumn(
            "pdf",
            F.when(F.col("_held"), pdf_markup(F.col("pmid"), pdf_base)).otherwise(F.col("pdf")),
        )
        .withColumn("html", html_object(F.col("pmid"), html_base))
        .select(*articles.columns)
    )


def pending_conversions(
    pdfs: DataFrame, htmls: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """PDFs that have no HTML of the same name.

    ``by`` lists columns (such as the project) that must agree as well.
    """
    keys = [*(by or []), "_html_name"]
    done = htmls.select(*(by or []), F.col("name").alias("_html_name")).distinct()
    asked = _pdf_names(pdfs).withColumn("_html_name", html_name(F.col("name")))
    return asked.join(done, keys, "left_anti").select(*pdfs.columns)


def fetch_plan(
    articles: DataFrame, pdfs: DataFrame, htmls: DataFrame
) -> DataFrame:
    """Add ``action``: ``update``, ``convert``, ``pmc``, ``doi`` or ``none``.

    Both inventories are put together by file stem in one aggregation, so the
    articles are joined once.
    """

    def stems(files: DataFrame, suffix: str, mark: str) -> DataFrame:
        return files.where(F.endswith("name", F.lit(suffix))).select(
            F.left("name", F.length("name") - len(suffix)).alias("_stem"),
            F.lit(mark == "_pdf").alias("_pdf"),
            F.lit(mark == "_html").alias("_html"),
        )

    held = (
        stems(pdfs, ".pdf", "_pdf")
        .unionByName(stems(htmls, ".html", "_html"))
        .groupBy("_stem")
        .agg(F.max("_pdf").alias("_pdf"), F.max("_html").alias("_html"))
        .where("_pdf")
    )
    action = (
        F.when(F.col("_pdf") & F.col("_html"), "update")
        .when(F.col("_pdf"), "convert")
        .when(F.col("pmcid") != "", "pmc")
        .when(F.col("doi") != "", "doi")
        .otherwise("none")
    )
    keyed = articles.withColumn("_stem", F.col("pmid").cast("string"))
    return (
        keyed.join(held, "_stem", "left")
        .withColumn("action", action)
        .select(*articles.columns, "action")
    )
