"""From bibliography entries to search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.bib import bib_entries, bib_field, bib_ids


def split_entries(files: DataFrame) -> DataFrame:
    """One row per entry of the texts ``(file_name, value)``, with its place ``pos`` in the file."""
    return files.select("file_name", F.posexplode(bib_entries(F.col("value"))).alias("pos", "entry")).select(
        "file_name",
        "pos",
        bib_field(F.col("entry"), "pmid").alias("pmid"),
        bib_field(F.col("entry"), "url").alias("url"),
    )


def build_query(entries: DataFrame, download_pdf: bool = False, strict: bool = False) -> DataFrame:
    """Ids of each file's entries joined by ``OR`` in their order, repeats kept.

    One row per file, whatever its size: the query is one text for the search
    service, so it has to be in one place.
    """
    ids = bib_ids(F.col("pmid"), F.col("url"), strict)
    ordered = F.array_sort(F.collect_list(F.struct("pos", ids.alias("ids"))))
    return (
        entries.groupBy("file_name")
        .agg(F.flatten(F.transform(ordered, lambda e: e["ids"])).alias("ids"))
        .select(
            "file_name",
            F.array_join("ids", " OR ").alias("query_str"),
            F.lit(download_pdf).alias("download_pdf"),
        )
    )
