"""Intermediate tables, shard counts and key spreading used by the operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.words import pieces

#: Bytes of text that one shard answers for, and the fewest shards there are.
SHARD_BYTES = 8 << 20
MIN_SHARDS = 64


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one the cluster shares (``spark.checkpoint.dir``).

    A local session without that setting gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_of(folder: str) -> str:
    """The catalog's name for a bucketed table in a folder."""
    return folder.rsplit("/", 1)[-1].replace("-", "_")


def freed(*frames: DataFrame) -> None:
    """Delete frames that ``stored`` or ``bucketed`` made, from folder and catalog; nothing may read them any more.

    The shuffle files of steps that are done go, too: Spark deletes them once the
    driver's garbage is collected, which long jobs with little garbage put off.
    """
    for frame in frames:
        spark = frame.sparkSession
        folders = {path.rsplit("/", 1)[0] for path in frame.inputFiles()}
        for folder in folders:
            spark.sql(f"DROP TABLE IF EXISTS {_table_of(folder)}")
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes in a text column, over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shards_for(size: int) -> int:
    """Shards for so many bytes, so that one shard fits a task at any size."""
    return max(MIN_SHARDS, math.ceil(size / SHARD_BYTES))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit hash, by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table that is dealt by piece."""
    return max(MIN_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """Write packed rows in buckets of a column, by which they are grouped without being moved."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    table = _table_of(path)
    writer = df.write.option("path", path).option("compression", "uncompressed")
    writer.bucketBy(bucket_count(spark), by).saveAsTable(table)
    return spark.table(table)


def staged(docs: DataFrame) -> DataFrame:
    """``piece, rows``: all rows in pieces of a few million bytes of text.

    ``rows`` is an Arrow stream with all columns. The table is stored in buckets of
    the piece number, so what other steps find out about a piece can be brought to
    it again and again without moving its texts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for part in pieces(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([data], names=["rows"])

    packed = docs.mapInArrow(pack, "rows binary")
    packed = packed.withColumn("piece", F.monotonically_increasing_id())
    return bucketed(packed, "piece", "staged")


def unpacked(data: bytes) -> pa.RecordBatch:
    """The rows of a piece."""
    return pa.ipc.open_stream(data).read_next_batch()
