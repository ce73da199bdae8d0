"""Bibliography files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.bibliography import split_entries


def read_bib_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry, with its file and its place there.

    A file is read as one text, since only its braces tell where an entry ends; so
    neither the size of splits nor the number of tasks changes the result. Keys
    are matched in any letter case; values stand in braces, quotes or as a bare
    number. ``@string`` macros are not expanded.
    """
    files = spark.read.text(path, wholetext=True)
    return split_entries(files.select(F.col("_metadata.file_name").alias("file_name"), "value"))
