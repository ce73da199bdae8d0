"""Which incoming ids are new, and which earlier records repeat them.

``incoming`` has a column ``pmid``; ``earlier`` has ``pmid`` and ``file_name``.
Files count in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import is_valid_pmid
from citeloom.operators.running import running_total
from citeloom.storage import materialized

_KEY = "_pmid_key"


def _is_numeric(df: DataFrame) -> bool:
    return isinstance(df.schema["pmid"].dataType, T.IntegralType)


def valid_pmids(articles: DataFrame) -> DataFrame:
    """Rows whose id is neither null, empty nor zero."""
    return articles.where(is_valid_pmid(F.col("pmid"), _is_numeric(articles)))


def with_key(*frames: DataFrame) -> list[DataFrame]:
    """Add the column ids are compared by.

    Ids are compared as text, so ``007`` is not ``7``. Where all sides hold
    numbers the outcome is the same without the cast, and cheaper.
    """
    kind = "bigint" if all(_is_numeric(df) for df in frames) else "string"
    return [df.withColumn(_KEY, F.col("pmid").cast(kind)) for df in frames]


def new_pmids(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """Incoming rows whose id is in no earlier file; repeats stay."""
    asked, held = with_key(incoming, valid_pmids(earlier))
    known = held.select(_KEY).distinct()
    return asked.join(known, _KEY, "left_anti").drop(_KEY)


def first_file(keyed: DataFrame) -> DataFrame:
    """First file of each key, with the number of records it has there.

    Counting by key and file before taking the first file lets every task
    reduce its own rows, so no key's records have to meet in one place.
    """
    per_file = keyed.groupBy(_KEY, "file_name").agg(F.count(F.lit(1)).alias("_records"))
    first = F.min(F.struct("file_name", "_records"))
    return (
        per_file.groupBy(_KEY)
        .agg(first.alias("_first"))
        .select(_KEY, "_first.file_name", "_first._records")
    )


def duplicated_articles(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """Full earlier records of incoming ids, from the first file that has them.

    If the id repeats within that file, all of its records there are kept. Earlier
    records are cut to the wanted ids before anything is counted.
    """
    asked, held = with_key(incoming, valid_pmids(earlier))
    mine = held.join(asked.select(_KEY).distinct(), _KEY, "left_semi")
    keys = [_KEY, "file_name"]
    return mine.join(first_file(mine).select(*keys), keys, "left_semi").drop(_KEY)


def dedup_tally(incoming: DataFrame, earlier: DataFrame) -> DataFrame:
    """Per earlier file, in order: repeats found, ids taken out, ids left."""
    incoming_keyed, held = with_key(incoming, valid_pmids(earlier))
    asked = incoming_keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_asked"))
    held = held.join(asked, _KEY, "left_semi")
    return tally(incoming, first_file(held).join(asked, _KEY), earlier)


def tally(incoming: DataFrame, hits: DataFrame, files: DataFrame) -> DataFrame:
    """The tally of incoming ids from the first files ``hits(file_name, _records, _asked)`` of them."""
    hits = hits.groupBy("file_name").agg(F.sum("_records").alias("_records"), F.sum("_asked").alias("_asked"))
    named = files.select("file_name").distinct()
    per_file = named.join(hits, "file_name", "left").select(
        "file_name",
        F.coalesce("_records", F.lit(0)).alias("duplicated_records"),
        F.coalesce("_asked", F.lit(0)).alias("removed_ids"),
    )
    total = incoming.agg(F.count(F.lit(1)).alias("total"))
    # One row per file; the running total starts from it more than once.
    per_file = materialized(per_file, "tally")
    return (
        running_total(per_file, "file_name", "removed_ids", "_gone")
        .withColumn("ids_left", total.scalar() - F.col("_gone"))
        .drop("_gone")
    )


def unique_key_lookup(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs exactly once; null keys never match."""
    others = [c for c in df.columns if c != key]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
        .where("_n = 1")
        .drop("_n")
    )
