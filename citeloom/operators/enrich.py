"""From raw articles to the fixed record, and journal factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.dedup import unique_key_lookup

# Public addresses the record links to, and its defaults.
PMC_PREFIX = "https://www.ncbi.nlm.nih.gov/pmc/articles/"
PUBMED_PREFIX = "https://pubmed.ncbi.nlm.nih.gov/"
DOI_PREFIX = "https://doi.org/"
DEFAULT_TAG = "Anonymous"
UNKNOWN_JOURNAL = "Unknown"
UNKNOWN_FACTOR = -1.0


def reject_reason() -> Column:
    """Why a raw row cannot become a record; null if it can."""
    no_author = F.col("authors").isNull() | F.exists("authors", lambda a: a.isNull())
    return F.when(F.col("pmid").try_cast("bigint").isNull(), "pmid is not a number").when(
        no_author, "authors are missing"
    )


def rejected_articles(raw: DataFrame) -> DataFrame:
    """Raw rows that are left out of the projection, with the reason."""
    return raw.withColumn("reason", reject_reason()).where("reason is not null")


def project_articles(
    raw: DataFrame, run_date: str, tag: str | Column | None = None
) -> DataFrame:
    """The seventeen-field record of every raw row that is complete.

    ``tag`` is the config's author. The link to the DOI is set even when there
    is no DOI.
    """
    pmc = F.coalesce("pmc", F.lit(""))
    doi = F.coalesce("doi", F.lit(""))
    label = tag if isinstance(tag, Column) else F.lit(tag or DEFAULT_TAG)
    return raw.where(reject_reason().isNull()).select(
        label.alias("tag"),
        F.col("pmid").try_cast("bigint").alias("pmid"),
        pmc.alias("pmcid"),
        F.when(pmc != "", F.concat(F.lit(PMC_PREFIX), pmc)).otherwise("").alias("pmc_link"),
        F.concat(F.lit(PUBMED_PREFIX), "pmid").alias("pubmed_link"),
        F.coalesce(F.replace("abstract", F.lit("\n"), F.lit(" ")), F.lit("")).alias("abstract"),
        "title",
        F.lit(run_date).alias("imported_date"),
        F.array_join("authors", ", ").alias("authors"),
        F.col("journal").alias("journal_abbr"),
        F.lit(UNKNOWN_JOURNAL).alias("journal"),
        F.lit("").alias("pdf"),
        F.lit("").alias("html"),
        F.lit(UNKNOWN_FACTOR).alias("impact_factor"),
        F.col("year").alias("publication"),
        doi.alias("doi"),
        F.concat(F.lit(DOI_PREFIX), doi).alias("doi_link"),
    )


def enrich_journal(articles: DataFrame, factors: DataFrame) -> DataFrame:
    """Set factor and journal name where exactly one journal matches.

    ``factors`` has ``key``, ``factor`` and ``journal``. Keys match the journal
    abbreviation in any letter case; no match or several give the defaults.
    """
    known = unique_key_lookup(
        factors.select(
            F.lower("key").alias("_journal_key"),
            F.col("factor").cast("double").alias("_factor"),
            F.col("journal").alias("_journal"),
        ),
        "_journal_key",
    )
    keyed = articles.withColumn("_journal_key", F.lower("journal_abbr"))
    return (
        keyed.join(known, "_journal_key", "left")
        .withColumn("impact_factor", F.coalesce("_factor", F.lit(UNKNOWN_FACTOR)))
        .withColumn("journal", F.coalesce("_journal", F.lit(UNKNOWN_JOURNAL)))
        .select(*articles.columns)
    )


def with_enrichment(
    articles: DataFrame, enrichment: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Apply the caller's own enrichment; without one the defaults stay."""
    return articles.transform(enrichment) if enrichment else articles
