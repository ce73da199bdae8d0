"""Query configs in JSON, flat YAML or as a bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.bib import bib_entries, bib_field, bib_ids
from citeloom.functions.paths import config_format
from citeloom.schemas import QUERY_CONFIG

_JSON_CONFIG = "query_str string, author string, download_pdf boolean, _broken string"
#: Names of files that may be configs; the router decides about them.
CONFIG_GLOB = "*{json,yaml,yml,bib,JSON,YAML,YML,BIB}"
_TRUE = ("true", "yes", "on")
_FALSE = ("false", "no", "off")


def _yaml_value(text: Column, key: str) -> Column:
    """Text of a top-level key; null if it is blank or of a kind that is not read.

    Plain and quoted values may go on in indented lines, which are folded; ``|``
    and ``>`` blocks are read as they are, their last line break dropped. Lists,
    maps, anchors, tags and quotes that do not end are not read.
    """
    lines = rf"(?m)^{key}:[ \t]*(.*+(?:\r?\n(?:[ \t]++.*+|[ \t]*+(?=\r?\n)))*+)"
    raw = F.regexp_replace(F.regexp_extract(text, lines, 1), "\r", "")
    return F.element_at(F.transform(F.array(raw), _yaml_scalar), 1)


def _yaml_scalar(raw: Column) -> Column:
    head = F.regexp_extract(raw, r"\A([^\n]*)", 1)
    rest = F.regexp_extract(raw, r"(?s)\A[^\n]*\n(.*)\z", 1)
    indent = F.regexp_extract(rest, r"\A(?:[ \t]*\n)*([ \t]+)", 1)
    inner = F.regexp_replace(F.regexp_replace(rest, F.concat(F.lit("(?m)^"), indent), F.lit("")), r"\s+\z", "")
    block = head.rlike(r"\A[|>][-+]?[ \t]*(?:#.*)?\z")
    folded_block = F.regexp_replace(inner, r"(?<!\n)\n(?!\n)", " ")
    flat = F.trim(F.regexp_replace(raw, r"[ \t]*\n\s*", " "))
    double = F.regexp_extract(flat, r'''\A"((?:[^"\\]|\\.)*+)"\s*(?:#.*)?\z''', 1)
    is_double = flat.rlike(r'''\A"(?:[^"\\]|\\["\\/nt])*+"(?:\s+#.*|\s*)\z''')
    for escaped, char in ((r"\n", "\n"), (r"\t", "\t"), (r"\/", "/"), (r'\"', '"'), ("\\\\", "\\")):
        double = F.replace(double, F.lit(escaped), F.lit(char))
    single = F.replace(F.regexp_extract(flat, r"\A'((?:[^']|'')*+)'", 1), F.lit("''"), F.lit("'"))
    is_single = flat.rlike(r"\A'(?:[^']|'')*+'(?:\s+#.*|\s*)\z")
    plain = F.trim(F.regexp_replace(flat, r"(?:\A|[ \t]+)#.*\z", ""))
    unread = plain.rlike(r"\A[\"'\[\]{}&*!|>%@`]")
    blank = F.lower(plain).isin("", "~", "null")
    return (
        F.when(block & F.startswith(head, F.lit("|")), inner)
        .when(block, folded_block)
        .when(is_double, double)
        .when(is_single, single)
        .when(~blank & ~unread, plain)
    )


def _yaml_config(text: Column) -> Column:
    flag = F.lower(_yaml_value(text, "download_pdf"))
    return F.struct(
        _yaml_value(text, "query_str").alias("query_str"),
        _yaml_value(text, "author").alias("author"),
        F.when(flag.isin(*_TRUE), True).when(flag.isin(*_FALSE), False).alias("download_pdf"),
    )


def _json_config(text: Column) -> Column:
    """Fields of a JSON object; null when the text is broken, no object, or goes on behind it."""
    parsed = F.from_json(text, _JSON_CONFIG, {"columnNameOfCorruptRecord": "_broken"})
    fields = [parsed[n].alias(n) for n in QUERY_CONFIG.fieldNames()]
    is_object = F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{"))
    # Read with a second object behind it, as a parser stops behind the first value.
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit(",{}]")), "array<string>")) == 2
    return F.when(is_object & parsed["_broken"].isNull() & alone, F.struct(*fields))


def _bib_config(text: Column) -> Column:
    """The query of a bibliography that was dropped in as a config."""
    ids = F.flatten(
        F.transform(bib_entries(text), lambda e: bib_ids(bib_field(e, "pmid"), bib_field(e, "url")))
    )
    return F.struct(
        F.array_join(ids, " OR ").alias("query_str"),
        F.lit(None).cast("string").alias("author"),
        F.lit(False).alias("download_pdf"),
    )


def parse_configs(files: DataFrame) -> DataFrame:
    """Config fields of each file ``(path, value)``.

    ``readable`` is false for malformed text and for formats that are not known.
    """
    kind = config_format(F.col("path"))
    text = F.col("value")
    as_yaml = F.when(text.rlike(r"(?m)^\w+:(?:\s|$)"), _yaml_config(text))
    as_bib = F.when(text.rlike(r"(?m)^\s*@\w+\s*[{(]"), _bib_config(text))
    config = (
        F.when(kind == "json", _json_config(text))
        .when(kind == "yaml", as_yaml)
        .when(kind == "bib", as_bib)
    )
    return files.select("*", config.alias("_c")).select(
        *[c for c in files.columns if c != "value"],
        F.col("_c").isNotNull().alias("readable"),
        "_c.query_str",
        "_c.author",
        "_c.download_pdf",
    )


def config_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and text of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # Files of other kinds, PDFs above all, are not opened.
    files = reader.option("pathGlobFilter", CONFIG_GLOB).load(path)
    return files.select("path", F.col("content").cast("string").alias("value"))


def read_query_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configs of all files below a folder: ``path``, ``readable`` and the fields."""
    return parse_configs(config_files(spark, path))
