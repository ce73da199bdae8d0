"""Article files and tables, duplicates, documents and run history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.schemas import ARTICLE, ARTICLE_IN_FILE, HISTORY
from citeloom.sources.arrays import read_array_files
from citeloom.storage import materialized


# White space of JSON texts.
_BLANK = " \t\r\n"
#: Bytes of a file that is still parsed as one text; what is larger is shared among tasks.
WHOLE_BYTES = 1 << 20
# What parts the records of a JSON array, by the layout of the file.
_SEPARATORS = {"lines": "\n", "indented": "\n  {"}


def _file_name() -> Column:
    return F.col("_metadata.file_name").alias("file_name")


def _file_texts(
    spark: SparkSession, path: str, pattern: str, layout: str
) -> DataFrame | None:
    reader = spark.read.option("pathGlobFilter", pattern)
    if layout != "any":
        reader = reader.option("lineSep", _SEPARATORS[layout])
    try:
        return reader.text(path, wholetext=layout == "any")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _array() -> Column:
    """Elements of the file's JSON array; null unless the text is a valid array and nothing else.

    A parser stops behind the first value. So the text is read with a second array
    behind it, and there have to be just these two.
    """
    is_list = F.startswith(F.ltrim("value", F.lit(_BLANK)), F.lit("["))
    both = F.concat(F.lit("["), "value", F.lit(",[]]"))
    parsed = F.when(is_list, F.from_json(both, T.ArrayType(T.ArrayType(ARTICLE_IN_FILE))))
    return F.get(F.filter(F.array(parsed), lambda x: F.size(x) == 2), 0)[0]


def _parts(texts: DataFrame, layout: str) -> DataFrame:
    """Records ``parts`` of each piece of a file that was split; null if malformed.

    A piece may hold any number of records: a compact array is one piece.
    """
    record = F.btrim("value", F.lit("[], \t\r\n"))
    if layout == "indented":
        cut = (record != "") & ~F.startswith(record, F.lit("{"))
        record = F.when(cut, F.concat(F.lit("{"), record)).otherwise(record)
    pieces = texts.select(record.alias("record"), _file_name()).where("record <> ''")
    whole = F.concat(F.lit("["), "record", F.lit("]"))
    objects = F.startswith("record", F.lit("{"))
    return pieces.select(
        F.when(objects, F.from_json(whole, T.ArrayType(ARTICLE_IN_FILE))).alias("parts"), "file_name"
    )


def _typed(articles: DataFrame) -> DataFrame:
    return articles.select(
        *[
            F.col(f"a.{f.name}").try_cast("bigint").alias("pmid")
            if f.name == "pmid"
            else F.col(f"a.{f.name}")
            for f in ARTICLE.fields
        ],
        "file_name",
    )


def _name(file: Column) -> Column:
    return F.url_decode(F.substring_index(file, "/", -1)).alias("file_name")


def _array_records(spark: SparkSession, path: str, pattern: str, above: int = 0) -> DataFrame | None:
    try:
        return materialized(read_array_files(spark, path, ARTICLE_IN_FILE, pattern, above), "records")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _parsed_articles(kept: DataFrame) -> DataFrame:
    return _typed(kept.select(F.col("parsed").alias("a"), _name(F.col("file"))))


def _split_articles(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    found = _array_records(spark, path, pattern)
    if found is None:
        return spark.createDataFrame([], T.StructType([*ARTICLE.fields]).add("file_name", "string"))
    kept = found.where("parsed IS NOT NULL").join(found.where("NOT good").select("file").distinct(), "file", "left_anti")
    return _parsed_articles(kept)


def _shared_or_whole(
    spark: SparkSession, path: str, pattern: str, texts: DataFrame
) -> tuple[DataFrame | None, DataFrame]:
    """Records of large files, read in splits, and the texts of the files to parse whole.

    These are the small ones, and large ones that the splits do not take for arrays of
    objects: some of them (with nulls among the records, or other quotes) still parse.
    """
    small = texts.where(F.col("_metadata.file_size") <= WHOLE_BYTES)
    large = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if large.where(F.col("length") > WHOLE_BYTES).select("path").isEmpty():
        return None, small
    found = _array_records(spark, path, pattern, above=WHOLE_BYTES)
    odd = [r["file"] for r in found.where("NOT good").select("file").distinct().collect()]
    found = found.where("parsed IS NOT NULL")
    if not odd:
        return found, small
    # Left out by name, since a join would bring a file's records to one task.
    found = found.where(~F.col("file").isin(odd))
    alone = F.col("_metadata.file_path").isin(odd)
    return found, texts.where((F.col("_metadata.file_size") <= WHOLE_BYTES) | alone)


def read_article_files(
    spark: SparkSession, path: str, layout: str = "any", pattern: str = "*.json"
) -> DataFrame:
    """Articles of all JSON files in a folder, with their ``file_name``.

    A missing folder reads as empty; a file that is malformed or holds no list
    is skipped. ``layout="any"`` parses each file of up to ``WHOLE_BYTES`` as one text,
    which suits the results of single queries, and reads larger ones as ``split`` does;
    of these, only what that rejects is parsed as one text. Files of any size are also
    shared among tasks if they keep to a layout: ``lines`` has one record per line, as
    ``write_articles`` makes them; ``indented`` has records that start two blanks in, as most JSON
    printers make them. There, a malformed piece (usually one record) is skipped
    by itself; a compact array is read as one piece. ``split`` shares arrays of any
    layout among tasks and, like ``any``, skips a file that is malformed anywhere.
    """
    if layout == "split":
        return _split_articles(spark, path, pattern)
    texts = _file_texts(spark, path, pattern, layout)
    if texts is None:
        schema = T.StructType([*ARTICLE.fields]).add("file_name", "string")
        return spark.createDataFrame([], schema)
    if layout == "any":
        found, whole = _shared_or_whole(spark, path, pattern, texts)
        whole = whole.select(F.explode(_array()).alias("a"), _file_name()).where("a is not null")
        return _typed(whole) if found is None else _typed(whole).unionByName(_parsed_articles(found))
    return _typed(_parts(texts, layout).select(F.explode("parts").alias("a"), "file_name"))


def rejected_article_files(
    spark: SparkSession, path: str, layout: str = "any", pattern: str = "*.json"
) -> DataFrame:
    """Files (or, in ``lines`` and ``indented``, records) that are skipped, with the reason."""
    if layout == "split":
        found = _array_records(spark, path, pattern)
        if found is None:
            return spark.createDataFrame([], "file_name string, reason string")
        return found.where("NOT good").select(_name(F.col("file")), F.lit("malformed").alias("reason")).distinct()
    texts = _file_texts(spark, path, pattern, layout)
    if texts is None:
        return spark.createDataFrame([], "file_name string, reason string")
    if layout == "any":
        reason = F.when(~F.startswith(F.ltrim("value", F.lit(_BLANK)), F.lit("[")), "not a list").when(
            _array().isNull(), "malformed"
        )
        _, whole = _shared_or_whole(spark, path, pattern, texts)
        return whole.select(_file_name(), reason.alias("reason")).where("reason is not null")
    broken = _parts(texts, layout).where("parts IS NULL")
    return broken.select("file_name", F.lit("malformed").alias("reason"))


def write_articles(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "error"
) -> None:
    """Write records as a table, also when there are none.

    ``parquet`` and ``json`` are Spark's own; ``json_array`` makes every file a
    JSON array with one record per line, and ``[]`` for no records. Those files
    are named ``part-*.txt``; say so in ``pattern`` when reading them.
    """
    if format != "json_array":
        df.write.format(format).mode(mode).save(path)
        return

    # Defined here so that it travels to the executors by value: they need not
    # have this package installed.
    def array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                marks = pa.array([lead] + [","] * (batch.num_rows - 1), pa.string())
                lines = pc.binary_join_element_wise(marks, batch.column(0).cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays([lines], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(array_lines, "value string").write.mode(mode).text(path)


def read_written_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of all collections that ``write_articles`` has put into a folder.

    Each collection is a folder of its own, and so are the repeats beside it;
    both are earlier results of the next run. ``file_name`` is the collection's
    name. A missing or empty folder reads as empty.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    schema = T.StructType([*ARTICLE.fields])
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    try:
        found = reader.option("pathGlobFilter", "*.parquet").parquet(folder)
        return found.select("*", F.url_decode(name).alias("file_name"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema.add("file_name", "string"))
        raise


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_duplicates(df: DataFrame, destination: str, mode: str = "error") -> bool:
    """Write repeats next to the destination, only if there are any."""
    # Written elsewhere first, so that the repeats are computed once.
    repeats = materialized(df, "repeats")
    if repeats.isEmpty():
        return False
    repeats.write.mode(mode).parquet(duplicates_path(destination))
    return True


def duplicates_path(destination: str) -> str:
    head, _, name = destination.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
    return f"{head}/{stem}_duplicated" if head else f"{stem}_duplicated"


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store fetched bytes: ``name``, ``url``, ``content`` and its hash."""
    df.select("name", "url", "content", F.md5("content").alias("md5")).write.mode(mode).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Add run summaries to the history table; nothing is read or rewritten."""
    df.select(*HISTORY.fieldNames()).write.mode("append").parquet(path)
