"""JSON arrays of any layout and size, read by many tasks.

Files are cut behind each closing brace, wherever tasks happen to start reading.
What such a piece does depends on whether it begins inside a string, so both cases
are worked out for each piece, and summed over a block, the span of a file that one
task reads. With the blocks of a file put in order, each piece's state is known:
inside a string or not, and how many brackets are open. Records that one piece
holds, as flat ones do, are parsed where they are; only pieces of others are
brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.storage import materialized

_PLACE = ["file", "block", "place"]
#: So many pieces of other kinds than most are told to all tasks by number; beyond, texts are shuffled to them.
FEW = 1_000_000


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _opened(outside: Column) -> Column:
    """Brackets that a text opens, less those it closes."""
    return _count(outside, "{") + _count(outside, "[") - _count(outside, "]") - _count(outside, "}")


def _pieces(spark: SparkSession, path: str, pattern: str, above: int) -> DataFrame:
    """``file, block, place, value`` and what each piece does, by how it begins.

    ``parity`` is 1 if strings are open behind it that were not before, or the other
    way round; ``out`` and ``in`` are the brackets it opens if it begins outside of
    strings, or inside. The brace behind it counts as its last character.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("lineSep", "}")
    pieces = reader.text(path).where(F.col("_metadata.file_size") > above).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    bare = pieces.withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    bare = bare.withColumn("parity", (_count(F.col("_bare"), '"') % 2).cast("int"))
    strings = r'"[^"]*(?:"|\z)'
    outside = _opened(F.regexp_replace("_bare", strings, ""))
    inside = _opened(F.regexp_replace(F.concat(F.lit('"'), "_bare"), strings, ""))
    # The closing brace counts if no string is open before it.
    return bare.select(
        *_PLACE,
        "value",
        "parity",
        (outside - (1 - F.col("parity"))).alias("out"),
        (inside - F.col("parity")).alias("in"),
    )


def _either(state: Column) -> Column:
    return F.when(state == 0, F.col("out")).otherwise(F.col("in"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Each piece with its state: ``quoted`` before it, and ``depth`` before and ``end`` behind it.

    Texts take no part: the rows that are sorted hold a few numbers each.
    """
    pieces = pieces.drop("value")
    before = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    pieces = pieces.withColumn("_turned", turned)
    pieces = pieces.withColumns({"_if_out": _either(F.col("_turned")), "_if_in": _either(1 - F.col("_turned"))})
    for name in ("_if_out", "_if_in"):
        pieces = pieces.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
    pieces = materialized(pieces, "sums")
    # One row per block; those of a file are few.
    blocks = pieces.groupBy("file", "block").agg(
        (F.sum("parity") % 2).alias("_parity"), F.sum("_if_out").alias("_all_out"), F.sum("_if_in").alias("_all_in")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_quoted", F.coalesce(F.sum("_parity").over(earlier), F.lit(0)) % 2)
    opened = F.when(F.col("_quoted") == 0, F.col("_all_out")).otherwise(F.col("_all_in"))
    blocks = blocks.withColumn("_open", opened).withColumn("_depth", F.coalesce(F.sum("_open").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    found = pieces.join(blocks.select("file", "block", "_quoted", "_depth", "_last"), ["file", "block"])
    is_out = F.col("_quoted") == 0
    depth = F.col("_depth") + F.when(is_out, F.col("_if_out_before")).otherwise(F.col("_if_in_before"))
    change = F.when(is_out, F.col("_if_out")).otherwise(F.col("_if_in"))
    return found.select(
        *_PLACE,
        "_last",
        ((F.col("_quoted") + F.col("_turned")) % 2).alias("quoted"),
        depth.alias("depth"),
        (depth + change).alias("end"),
        ((F.col("_quoted") + F.col("_turned") + F.col("parity")) % 2).alias("quoted_end"),
    )


def read_array_files(
    spark: SparkSession, path: str, record: T.StructType, pattern: str, above: int = 0
) -> DataFrame:
    """``file, parsed, good`` of each record of the arrays, and one row for the end of each file.

    Only files of more than ``above`` bytes are read.

    ``good`` is false where a file is no array of objects from its first to its
    last character; such a file has at least one such row. The row for the end has
    no record.
    """
    pieces = materialized(_pieces(spark, path, pattern, above), "pieces")
    placed = materialized(_placed(pieces), "placed")
    ends_at = placed.where("_last").groupBy("file").agg(F.max("place").alias("place"))
    placed = placed.join(ends_at.select("place", F.lit(True).alias("_tail")), "place", "left")
    starts = (F.col("quoted") == 0) & (F.col("depth") <= 1)
    whole = starts & (F.col("quoted_end") == 0) & (F.col("end") == 1)
    # Most pieces are a record behind another one. Only the others are sought out and brought together.
    usual = whole & (F.col("depth") == 1) & F.col("_tail").isNull()
    states = materialized(placed.where(~usual), "states")
    sought = states.select("place")
    if states.count() <= FEW:
        sought = F.broadcast(sought)
    others = pieces.select("place", "value").join(sought, "place", "left_semi")
    others = materialized(others.join(states, "place"), "others")
    follow = pieces.join(sought, "place", "left_anti")
    # Behind the last piece there is no brace; nothing but the array's end may be there.
    tails = others.where("_tail")
    # A file without an object is one piece.
    alone = (F.col("depth") == 0) & F.col("value").rlike(r"\A[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*\z")
    ends = (F.col("depth") == 1) & F.col("value").rlike(r"\A[ \t\r\n]*\][ \t\r\n]*\z")
    tails = tails.withColumn("good", (F.col("quoted") == 0) & (alone | ends))
    bodies = others.where("_tail IS NULL")
    single = bodies.where(whole).select("file", "depth", F.col("value").alias("text"))
    single = single.unionByName(follow.select("file", F.lit(1).cast("long").alias("depth"), F.col("value").alias("text")))
    # The other pieces of a file, counted by the records they end.
    parts = bodies.where(~whole)
    closed = F.sum(((F.col("quoted_end") == 0) & (F.col("end") == 1)).cast("int"))
    earlier = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("number", F.coalesce(closed.over(earlier), F.lit(0)))
    several = parts.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "value", "depth"))).alias("all")
    )
    several = several.select(
        "file", F.col("all")[0]["depth"].alias("depth"), F.array_join(F.col("all.value"), "}").alias("text")
    )
    found = single.unionByName(several)
    # The first record stands behind the bracket, each other one behind a comma.
    lead = F.when(F.col("depth") == 0, r"(?s)\A[ \t\r\n]*\[[ \t\r\n]*(\{.*)\z").otherwise(
        r"(?s)\A[ \t\r\n]*,[ \t\r\n]*(\{.*)\z"
    )
    text = F.regexp_extract_all("text", lead, F.lit(1))
    text = F.concat(F.try_element_at(text, F.lit(1)), F.lit("}"))
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(wrapped, T.ArrayType(record))
    found = found.select("file", parsed.alias("p"))
    found = found.select("file", F.get("p", 0).alias("parsed"), (F.coalesce(F.size("p"), F.lit(0)) == 1).alias("good"))
    none = F.lit(None).cast(record).alias("parsed")
    return found.unionByName(tails.select("file", none, "good"))
