"""File inventories, and folders read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from citeloom.schemas import BINARY_FILE, BUCKET_EVENT


def file_inventory(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Path, name and length of the files below a folder. Contents are not read.

    Paths start with the file system's scheme, such as ``file:``. Files without
    any content are not listed. The driver lists the folder: for very many
    files, keep their names in a table, which the operators take just as well.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    )


def _limited(reader: DataStreamReader, files_per_trigger: int | None) -> DataStreamReader:
    """At most so many files in a batch, which bounds the first one too."""
    if files_per_trigger is None:
        return reader
    return reader.option("maxFilesPerTrigger", files_per_trigger)


def bucket_events(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of notifications dropped into a folder as JSON."""
    return _limited(spark.readStream.schema(BUCKET_EVENT), files_per_trigger).json(path)


def _binary(
    spark: SparkSession, path: str, pattern: str, files_per_trigger: int | None
) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return _limited(reader, files_per_trigger).load(path)


def new_files(
    spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of files as they appear: path, time and length, each file once."""
    files = _binary(spark, path, pattern, files_per_trigger)
    return files.select("path", "modificationTime", "length")


def new_texts(
    spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of whole small files as they appear: path and text.

    Files that ``pattern`` leaves out are not opened.
    """
    files = _binary(spark, path, pattern, files_per_trigger)
    return files.select("path", F.col("content").cast("string").alias("value"))
