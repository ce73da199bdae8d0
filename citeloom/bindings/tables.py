"""Input shapes built from the test tables, in Spark and in SQL.

Each frame has a SQL twin of the same name in upper case: a ``WITH`` item that
the checking queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DATE = "2024-01-31"
TAG = "Reader"
ROOT = "/data"
PDF_BASE = "https://files.example.org/pdf"
HTML_BASE = "s3://papers/html"
CSS = "body > #sidebar { display: none; }"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_articles(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    head = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        doc.cast("string").alias("pmid"),
        F.when(doc % 3 == 0, F.concat(F.lit("PMC"), doc)).alias("pmc"),
        F.when(doc % 5 != 0, F.col("text")).alias("abstract"),
        head.alias("title"),
        F.when(doc % 11 != 0, F.split(head, " ")).alias("authors"),
        F.col("source").alias("journal"),
        (doc % 24 + 2000).cast("string").alias("year"),
        F.when(doc % 4 != 0, F.concat(F.lit("10.1000/"), doc)).alias("doi"),
    )


RAW_ARTICLES = """
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid,
         CASE WHEN doc_id % 3 = 0 THEN 'PMC' || doc_id END AS pmc,
         CASE WHEN doc_id % 5 <> 0 THEN text END AS abstract,
         split_part(text, chr(10), 1) AS title,
         CASE WHEN doc_id % 11 <> 0
              THEN string_split(split_part(text, chr(10), 1), ' ') END AS authors,
         source AS journal,
         CAST(doc_id % 24 + 2000 AS VARCHAR) AS year,
         CASE WHEN doc_id % 4 <> 0 THEN '10.1000/' || doc_id END AS doi
  FROM documents)"""

ARTICLES = (
    RAW_ARTICLES
    + f""",
articles AS (
  SELECT '{TAG}' AS tag, CAST(pmid AS BIGINT) AS pmid, coalesce(pmc, '') AS pmcid,
         CASE WHEN pmc IS NULL THEN ''
              ELSE 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmc END AS pmc_link,
         'https://pubmed.ncbi.nlm.nih.gov/' || pmid AS pubmed_link,
         coalesce(replace(abstract, chr(10), ' '), '') AS abstract,
         title, '{RUN_DATE}' AS imported_date, array_to_string(authors, ', ') AS authors,
         journal AS journal_abbr, 'Unknown' AS journal, '' AS pdf, '' AS html,
         CAST(-1 AS DOUBLE) AS impact_factor, year AS publication,
         coalesce(doi, '') AS doi, 'https://doi.org/' || coalesce(doi, '') AS doi_link
  FROM raw WHERE authors IS NOT NULL)"""
)


def journal_factors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.concat(F.lit("SRC"), F.col("n_nationkey") % 15).alias("key"),
        (F.col("n_nationkey") + 0.5).cast("double").alias("factor"),
        F.col("n_name").alias("journal"),
    )


FACTORS = """
factors AS (
  SELECT 'SRC' || (n_nationkey % 15) AS key, CAST(n_nationkey + 0.5 AS DOUBLE) AS factor,
         n_name AS journal
  FROM nation)"""


def incoming_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pmid"))


INCOMING = """
incoming AS (
  SELECT o_orderkey AS pmid FROM orders)"""


def earlier_articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pmid"),
        F.col("l_returnflag").alias("file_name"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


EARLIER = """
earlier AS (
  SELECT l_orderkey AS pmid, l_returnflag AS file_name, l_linenumber AS line,
         l_partkey AS part, l_suppkey AS supp
  FROM lineitem)"""


def pdf_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.concat(F.col("page_id"), F.lit(".pdf")).alias("name"))


def html_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.concat(F.col("doc_id"), F.lit(".html")).alias("name"))


FILES = """
pdfs AS (SELECT page_id || '.pdf' AS name FROM pages),
htmls AS (SELECT doc_id || '.html' AS name FROM labels)"""

_DIRS = {"signup": "config", "click": "config", "purchase": "pdf", "view": "html", "error": "pdf"}
_SUFFIXES = {"signup": ".json", "click": ".bib", "purchase": ".pdf", "view": ".html", "error": ".hidden"}


def _pick(column: str, values: dict[str, str]):
    expr = F.lit(None).cast("string")
    for key, value in values.items():
        expr = F.when(F.col(column) == key, value).otherwise(expr)
    return expr


def notification_columns(events: DataFrame) -> DataFrame:
    """Notification shape of event rows, of a batch or a stream."""
    name = F.when(F.col("event_id") % 4 == 0, "s3:ObjectRemoved:Delete").otherwise(
        "s3:ObjectCreated:Put"
    )
    key = F.concat(
        _pick("event_type", _DIRS), F.lit("/"), F.col("event_id"), _pick("event_type", _SUFFIXES)
    )
    bucket = F.concat(F.lit("p"), F.col("user_id") % 5)
    record = F.struct(
        name.alias("eventName"),
        F.struct(
            F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")
        ).alias("s3"),
    )
    return events.select(
        F.col("event_id").cast("string").alias("time"), F.array(record).alias("Records")
    )


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    return notification_columns(table(spark, sf, "events"))


EVENTS = f"""
records AS (
  SELECT CAST(event_id AS VARCHAR) AS time,
         CASE WHEN event_id % 4 = 0 THEN 's3:ObjectRemoved:Delete'
              ELSE 's3:ObjectCreated:Put' END AS event_type,
         'p' || (user_id % 5) AS bucket_name,
         CASE event_type WHEN 'signup' THEN 'config' WHEN 'click' THEN 'config'
                         WHEN 'view' THEN 'html' ELSE 'pdf' END || '/' || event_id ||
         CASE event_type WHEN 'signup' THEN '.json' WHEN 'click' THEN '.bib'
                         WHEN 'purchase' THEN '.pdf' WHEN 'view' THEN '.html'
                         ELSE '.hidden' END AS object_key
  FROM events),
created AS (
  SELECT *, '{ROOT}/' || bucket_name || '/' || object_key AS path
  FROM records WHERE starts_with(event_type, 's3:ObjectCreated')),
routed AS (
  SELECT *, bucket_name AS project,
         CASE WHEN object_key LIKE 'pdf/%.pdf' THEN 'pdf'
              WHEN object_key LIKE 'config/%' THEN 'config' ELSE 'ignored' END AS route
  FROM created)"""


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("title")
    )


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("organization"),
        F.col("c_custkey").alias("id"),
        F.concat("c_name", F.lit("@x.org")).alias("email"),
        F.when(
            F.col("c_custkey") % 11 != 0,
            (F.col("c_mktsegment") == "MACHINERY") | (F.col("c_nationkey") == 0),
        ).alias("is_superuser"),
    )


def registered_users(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").where("c_custkey % 3 = 0")
    return customers.select(F.concat("c_name", F.lit("@x.org")).alias("accessKey"))


ACCOUNTS = r"""
orgs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title,
         trim(regexp_replace(lower(n_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS bucket
  FROM nation),
memberships AS (
  SELECT CAST(c_nationkey AS BIGINT) AS organization, c_custkey AS id,
         c_name || '@x.org' AS email,
         CASE WHEN c_custkey % 11 <> 0
              THEN c_mktsegment = 'MACHINERY' OR c_nationkey = 0 END AS is_superuser
  FROM customer),
registered AS (
  SELECT c_name || '@x.org' AS accessKey FROM customer WHERE c_custkey % 3 = 0),
members AS (
  SELECT m.organization, o.bucket, m.id, m.email,
         m.email IN (SELECT accessKey FROM registered) AS is_registered
  FROM memberships m JOIN orgs o ON o.id = m.organization
  WHERE m.is_superuser IS NOT TRUE)"""


def bib_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Bibliography text: one entry per document, a file per source.

    Some abstracts hold lines that look like entries, and there are comments.
    """
    doc = F.col("doc_id")
    pmid = F.when(doc % 2 == 0, F.concat(F.lit(",\n  pmid = {"), doc, F.lit("}"))).otherwise("")
    url = (
        F.when(doc % 6 == 0, F.concat(F.lit(',\n  URL = "https://pubmed.example.org/'), doc + 7, F.lit('"')))
        .when(doc % 3 == 0, ",\n  url = {https://pubmed.example.org/}")
        .when(doc % 5 == 0, ",\n  url = {https://journal.example.org/1}")
        .otherwise("")
    )
    abstract = F.when(doc % 4 == 0, ",\n  abstract = {see\n@misc{x, {a}} and\n@home}").otherwise("")
    comment = F.when(doc % 9 == 0, "@comment{c, pmid = {1}}\n").otherwise("")
    entry = F.concat(
        comment, F.lit("@article{k"), doc, F.lit(",\n  title = {T}"), abstract, pmid, url, F.lit("\n}\n")
    )
    entries = table(spark, sf, "documents").select("source", doc.alias("doc"), entry.alias("entry"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc", "entry"))), lambda e: e["entry"])
    return entries.groupBy(F.col("source").alias("file_name")).agg(F.array_join(texts, "").alias("value"))


BIB = """
entries AS (
  SELECT source AS file_name,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS pos,
         CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS pmid,
         CASE WHEN doc_id % 6 = 0 THEN 'https://pubmed.example.org/' || (doc_id + 7)
              WHEN doc_id % 3 = 0 THEN 'https://pubmed.example.org/'
              WHEN doc_id % 5 = 0 THEN 'https://journal.example.org/1' END AS url
  FROM documents)"""


def config_columns(documents: DataFrame) -> DataFrame:
    """Config files in five formats, some empty or broken, of a batch or a stream."""
    doc = F.col("doc_id")
    query = F.when(doc % 7 != 0, F.concat(F.lit("it's "), doc)).otherwise("")
    kind = doc % 5
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".json", ".yaml", ".bib", ".yml", ".txt")]), (kind + 1).cast("int")
    )
    json = F.to_json(
        F.struct(query.alias("query_str"), F.col("source").alias("author"), (doc % 2 == 0).alias("download_pdf"))
    )
    broken = F.when(doc % 13 == 0, F.concat(F.lit("{"), json)).otherwise(json)
    yaml = F.concat(F.lit('query_str: "'), query, F.lit('"\ndownload_pdf: yes # all\n'))
    bib = F.concat(F.lit("@article{k, pmid = "), doc, F.lit("}\n"))
    text = F.when(kind == 0, broken).when(kind == 2, bib).otherwise(yaml)
    folder = F.when(doc % 17 == 0, "/config/old/q").otherwise("/config/q")
    path = F.concat(F.lit(f"{ROOT}/"), F.col("source"), folder, doc, suffix)
    return documents.select(path.alias("path"), text.alias("value"))


def config_texts(spark: SparkSession, sf: str) -> DataFrame:
    return config_columns(table(spark, sf, "documents"))


def metadata_files(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").where("doc_id % 3 = 0")
    return documents.select(
        F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/metadata/q"), "doc_id", F.lit(".json")).alias("path")
    )


def source_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source a config in each format, all but the last two for one destination."""
    lines = table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    json = F.to_json(F.struct(F.concat(F.lit("it's "), "high").alias("query_str"), F.col("source").alias("author"), (F.col("n") % 2 == 0).alias("download_pdf")))
    json = F.when(F.col("low") % 7 == 0, F.concat(json, F.lit("}"))).otherwise(F.replace(json, F.lit(","), F.lit(",\n  ")))
    yaml = F.concat(F.lit("# by hand\nauthor: 'O''Neil'\nquery_str: >\n  more than\n  "), "n", F.lit("\ndownload_pdf: Yes # all\n"))
    bib = F.concat(F.lit("@article{a, title = {{One}, two}, pmid = {"), "low", F.lit('}}\n@misc{b,\n  url = "https://pubmed.example.org/'), "high", F.lit('"}'))
    texts = [(".json", json), (".yaml", yaml), (".bib", bib), (".yml", yaml), (".txt", F.lit("none"))]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), v.alias("value")) for s, v in texts]))
    path = F.concat("source", F.lit("/config/q"), "low", "c.suffix")
    return lines.select("*", each.alias("c")).select(path.alias("path"), "c.value")


SOURCE_CONFIGS = """
lines AS (SELECT source, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM documents GROUP BY source),
source_configs AS (
  SELECT source || '/config/q' || low || suffix AS path, source AS project,
         source || '/metadata/q' || low || '.json' AS destination, suffix,
         suffix IN ('.yaml', '.bib') OR (suffix = '.json' AND low % 7 <> 0) AS readable,
         CASE WHEN NOT readable THEN NULL WHEN suffix = '.json' THEN 'it''s ' || high
              WHEN suffix = '.yaml' THEN 'more than ' || n ELSE low || ' OR ' || high END AS query_str,
         CASE WHEN NOT readable THEN NULL WHEN suffix = '.json' THEN source
              WHEN suffix = '.yaml' THEN 'O''Neil' END AS author,
         CASE WHEN NOT readable THEN NULL WHEN suffix = '.json' THEN n % 2 = 0 ELSE suffix = '.yaml' END AS download_pdf
  FROM (SELECT *, unnest(['.json', '.yaml', '.bib', '.yml', '.txt']) AS suffix FROM lines))"""


def named_files(files: DataFrame, folder: str) -> None:
    """Write each ``value`` into a file of the name ``path`` below a folder.

    The tasks write; then each file is given its name, one after another, so this
    is for a few hundred files.
    """
    jvm, sc = files.sparkSession._jvm, files.sparkSession.sparkContext
    files.select("value", F.hex(F.encode("path", "UTF-8")).alias("name")).write.partitionBy("name").text(f"{folder}/_new")
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    for part in fs.globStatus(place(f"{folder}/_new/name=*/part-*")):
        name = bytes.fromhex(part.getPath().getParent().getName().removeprefix("name=")).decode()
        fs.mkdirs(place(f"{folder}/{name}").getParent())
        fs.rename(part.getPath(), place(f"{folder}/{name}"))
    fs.delete(place(f"{folder}/_new"), True)


CONFIGS = f"""
parsed AS (
  SELECT source AS project, doc_id,
         '{ROOT}/' || source || CASE WHEN doc_id % 17 = 0 THEN '/config/old/q' ELSE '/config/q' END
           || doc_id || CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.yaml' WHEN 2 THEN '.bib'
                                        WHEN 3 THEN '.yml' ELSE '.txt' END AS path,
         '{ROOT}/' || source || '/metadata/q' || doc_id || '.json' AS destination,
         CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 2 THEN 'bib'
                         ELSE 'invalid' END AS format,
         NOT (doc_id % 5 = 0 AND doc_id % 13 = 0) AS readable,
         CASE WHEN doc_id % 5 = 2 THEN CAST(doc_id AS VARCHAR)
              WHEN doc_id % 7 = 0 THEN '' ELSE 'it''s ' || doc_id END AS query_str,
         CASE WHEN doc_id % 5 = 0 THEN source END AS author,
         CASE doc_id % 5 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN true ELSE false END AS download_pdf
  FROM documents),
checked AS (
  SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'config_missing'
                 WHEN format = 'invalid' THEN 'config_bad_format'
                 WHEN NOT readable THEN 'config_unreadable'
                 WHEN doc_id % 3 = 0 THEN 'destination_exists'
                 WHEN query_str = '' THEN 'empty_query' END AS reason
  FROM parsed)"""
