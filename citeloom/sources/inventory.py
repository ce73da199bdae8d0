"""A file inventory that is kept as a log.

Each listing adds what has come and gone since the one before; the present state is
the last word on each path. So a run lists only the folders in which something
changed, which events tell, and reads the rest from the log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.files import file_inventory
from citeloom.storage import materialized

LOG = "path string, name string, length bigint, present boolean, listing bigint"


def _log(spark: SparkSession, log: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(log)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LOG)
        raise


def _folded(rows: DataFrame) -> DataFrame:
    """Files that are there by the last listing that tells of them."""
    last = F.max_by(F.struct("name", "length", "present"), "listing").alias("last")
    return rows.groupBy("path").agg(last).where("last.present").select("path", "last.name", "last.length")


def present_files(spark: SparkSession, log: str) -> DataFrame:
    """Path, name and length of the files that are there, as ``file_inventory`` has them."""
    return _folded(_log(spark, log))


def _inside(folders: list[str]) -> Column:
    """Whether a path lies below one of the folders."""
    found = F.lit(False)
    for folder in folders:
        found |= F.startswith(F.col("path"), F.lit(f"{folder.rstrip('/')}/"))
    return found


def changed_folders(paths: DataFrame) -> DataFrame:
    """The folders of changed files, from a frame or batch of their ``path``."""
    return paths.select(F.regexp_extract("path", r"(?s)\A(.*)/", 1).alias("folder")).distinct()


def record_listing(
    spark: SparkSession, log: str, folders: list[str], listing: int, suffix: str = ""
) -> DataFrame:
    """List some folders, log what has come and gone there as listing ``listing``, and give that.

    Folders are named as the files' paths begin, with the scheme. One that is no
    longer there has lost its files. Listings count upwards; one that broke off is
    repeated under its number, and compared with those before it.
    """
    held = _folded(_log(spark, log).where(F.col("listing") < listing)).where(_inside(folders))
    listed = spark.createDataFrame([], "path string, name string, length bigint")
    for folder in folders:
        try:
            listed = listed.unionByName(file_inventory(spark, folder, suffix))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    # Folders may lie in each other.
    listed = materialized(listed.distinct(), "listing")
    held = materialized(held, "held")
    come = listed.join(held, ["path", "length"], "left_anti").withColumn("present", F.lit(True))
    gone = held.join(listed, "path", "left_anti").withColumn("present", F.lit(False))
    changes = come.select("path", "name", "length", "present").unionByName(gone.select("path", "name", "length", "present"))
    changes.write.mode("overwrite").parquet(f"{log}/listing={listing}")
    return _log(spark, log).where(F.col("listing") == listing)
