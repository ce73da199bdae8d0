"""An index of the ids that earlier files hold: first file and number of records there.

Deduplication asks of all earlier records only which file has an id first. The
index keeps that, one row per id, in buckets of the id, so that a run shuffles its
own ids and reads the index where it lies. Each run merges its records into a new
version, bucket by bucket.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.dedup import first_file, tally, valid_pmids
from citeloom.storage import shared_dir

#: Ids of one bucket.
BUCKET_IDS = 2_000_000
_KEY = "_pmid_key"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_KEY, F.col("pmid").cast("string"))


class Index(NamedTuple):
    """A version of the index: its table, how many buckets that has, and its rows."""

    table: str
    buckets: int
    rows: DataFrame


def _written(index: DataFrame, buckets: int) -> Index:
    """Write a version as a bucketed table in the shared folder."""
    spark = index.sparkSession
    name = f"first_files_{uuid.uuid4().hex}"
    writer = index.write.option("path", shared_dir(spark, "first-files")).bucketBy(buckets, _KEY).sortBy(_KEY)
    writer.saveAsTable(name)
    return Index(name, buckets, spark.table(name))


def build_index(earlier: DataFrame) -> Index:
    """The index of all earlier records, as many buckets as they need."""
    rows = _keyed(valid_pmids(earlier))
    ids = rows.select(F.approx_count_distinct(_KEY)).first()[0]
    return _written(first_file(rows), max(1, math.ceil(ids / BUCKET_IDS)))


def load_index(spark: SparkSession, table: str) -> Index:
    """The version that a table holds."""
    told = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return Index(table, int(told["data_type"]), spark.table(table))


def merged_index(index: Index, added: DataFrame) -> Index:
    """A new version with the records of further files.

    Of the old version nothing is shuffled: new ids come to its buckets. A file
    that is in it already keeps the larger number of records of an id.
    """
    new = first_file(_keyed(valid_pmids(added)))
    old = index.rows.select(_KEY, F.struct("file_name", "_records").alias("_old"))
    joined = old.join(new.select(_KEY, F.struct("file_name", "_records").alias("_new")), _KEY, "full_outer")
    same = F.col("_old.file_name") == F.col("_new.file_name")
    first = F.when(same, F.greatest("_old", "_new")).otherwise(F.least("_old", "_new"))
    kept = joined.select(_KEY, first.alias("_first")).select(_KEY, "_first.file_name", "_first._records")
    return _written(kept, index.buckets)


def new_pmids_by_index(incoming: DataFrame, index: Index) -> DataFrame:
    """Incoming rows whose id the index does not hold; repeats stay."""
    return _keyed(incoming).join(index.rows.select(_KEY), _KEY, "left_anti").drop(_KEY)


def tally_by_index(incoming: DataFrame, index: Index, files: DataFrame) -> DataFrame:
    """Per earlier file ``files(file_name)``, in order: repeats found, ids taken out, ids left."""
    asked = _keyed(incoming).groupBy(_KEY).agg(F.count(F.lit(1)).alias("_asked"))
    return tally(incoming, index.rows.join(asked, _KEY), files)
