"""Page plans, results of search pages, page unions and result limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.html import search_results

PAGE_SIZE = 250
RESULT_LIMIT = 10
_SPAN = 10_000

# Up to this limit Spark cuts each task's rows of a query before the shuffle.
_CUT_BEFORE_SHUFFLE = 1_000
_SALTS = 256


def page_plan(counts: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Pages and offsets needed for ``n`` hits: ``n div size + 1`` pages.

    A multiple of the size gets one empty page at the end, and so does zero.
    Pages come in spans of ten thousand, so no row ever holds more than that.
    """
    last = F.expr(f"n div {size}")
    return (
        counts.withColumn("_last", last)
        .withColumn("_span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_last div {_SPAN}"))))
        .withColumn("_from", F.col("_span") * _SPAN)
        .withColumn(
            "page",
            F.explode(F.sequence("_from", F.least(F.col("_last"), F.col("_from") + (_SPAN - 1)))),
        )
        .withColumn("offset", F.col("page") * size)
        .select(*counts.columns, "page", "offset")
    )


def result_rows(pages: DataFrame) -> DataFrame:
    """One row per result of the search pages ``(query, page, html)``.

    The extraction is exploded as it stands: taken from a column, Spark would
    run it once more to leave out pages without results.
    """
    papers = F.posexplode(search_results(F.col("html"))).alias("pos", "paper")
    rows = pages.select("query", "page", papers)
    return rows.select("query", "page", "pos", "paper.name", "paper.url")


def concat_pages(pages: DataFrame) -> DataFrame:
    """All ids of all pages, repeats kept: one row per id of the pages ``(page, ids)``.

    Pages are rows of one frame, however many there are, so the plan does not grow
    with them.
    """
    others = [c for c in pages.columns if c != "ids"]
    return pages.select(*others, F.explode("ids").alias("pmid"))


def limit_results(
    results: DataFrame,
    n: int = RESULT_LIMIT,
    query: str = "query",
    order: tuple[str, ...] = ("page", "pos"),
) -> DataFrame:
    """First ``n`` results of each query in page order.

    Every task first cuts its own rows of a query to ``n``, so a query with
    very many results does not gather in one place. For a large ``n`` Spark
    does not do that by itself; then the rows of a query are cut in salted
    groups before they meet.
    """

    def cut(df: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    if n > _CUT_BEFORE_SHUFFLE:
        salted = results.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
        results = cut(salted, query, "_salt").drop("_salt")
    return cut(results, query)
