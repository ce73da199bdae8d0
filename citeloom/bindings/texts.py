"""Queries over page, query, identifier and bibliography texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.bindings import tables as t
from citeloom.functions.html import (
    distinct_links,
    embed_style,
    extract_pdf_link,
    extract_search_results,
    resolve_iframe,
)
from citeloom.functions.paths import config_format, document_name
from citeloom.functions.text import classify_identifier, normalize_query, pmid_from_url, slug
from citeloom.operators.bibliography import build_query, split_entries
from citeloom.operators.configs import checked_configs, config_stages, validate_configs
from citeloom.operators.paging import limit_results, result_rows
from citeloom.sources.bibliography import read_bib_entries
from citeloom.sources.configs import parse_configs, read_query_configs
from citeloom.storage import shared_dir


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "pages")


def q_normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    query = F.concat(F.lit("'"), "text", F.lit("' OR '"), "source", F.lit("'"))
    return t.table(spark, sf, "documents").select("doc_id", normalize_query(query).alias("query_str"))


_NORMALIZE = """SELECT doc_id,
  replace('''' || text || ''' OR ''' || source || '''', '''', '"') AS query_str FROM documents"""


def q_classify_identifier(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(
        F.col("url"),
        F.concat("url", F.lit(".pdf")),
        F.col("page_id").cast("string"),
        F.concat(F.lit("10.1000/"), "page_id"),
        F.lit(""),
    )
    return (
        _pages(spark, sf)
        .select("page_id", F.explode(ids).alias("identifier"))
        .withColumn("kind", classify_identifier(F.col("identifier")))
    )


_CLASSIFY = r"""SELECT page_id, identifier,
  CASE WHEN starts_with(identifier, 'http')
       THEN CASE WHEN suffix(identifier, 'pdf') THEN 'url-direct' ELSE 'url-non-direct' END
       WHEN regexp_full_match(identifier, '\p{Nd}+') THEN 'pmid' ELSE 'doi' END AS kind
FROM (SELECT page_id, unnest([url, url || '.pdf', CAST(page_id AS VARCHAR), '10.1000/' || page_id, ''])
             AS identifier FROM pages)"""


def q_document_name(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return _pages(spark, sf).select(
        "page_id",
        document_name(F.col("url"), html).alias("name"),
        document_name(F.concat("url", F.lit("#view=FitH")), html).alias("viewed_name"),
    )


_NAMES = """SELECT page_id, md5(html) || '-' || right(last, 20) AS name,
  md5(html) || '-' || right(regexp_replace(last || '#view=FitH', '#view=.+', ''), 20) AS viewed_name
FROM (SELECT *, string_split(url, '/')[-1] AS last FROM pages)"""


def q_pmid_from_url(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://pubmed.example.org/"), "page_id"))
    trailing = F.concat(F.lit("https://pubmed.example.org/"), "page_id", F.lit("/"))
    return _pages(spark, sf).select(
        "page_id",
        pmid_from_url(F.coalesce(url, F.col("url"))).alias("pmid"),
        pmid_from_url(trailing).alias("trailing"),
    )


_FROM_URL = """SELECT page_id,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR)
       WHEN contains(url, 'pubmed') THEN string_split(url, '/')[-1] END AS pmid,
  '' AS trailing FROM pages"""


def q_slug(spark: SparkSession, sf: str) -> DataFrame:
    """Of the title, which is the first line, and of the whole text."""
    return t.table(spark, sf, "documents").select(
        "doc_id",
        slug(F.substring_index("text", "\n", 1)).alias("slug"),
        slug(F.col("text")).alias("whole"),
    )


_SLUG = r"""SELECT doc_id, trim(lower(regexp_replace(split_part(text, chr(10), 1),
  '[^\p{L}\p{N}]+', '-', 'g')), '-') AS slug,
  trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '-', 'g')), '-') AS whole FROM documents"""


def q_config_format(spark: SparkSession, sf: str) -> DataFrame:
    texts = t.config_texts(spark, sf)
    return texts.select("path", config_format(F.col("path")).alias("format"))


_FORMAT = f"WITH {t.CONFIGS} SELECT path, format FROM parsed"


def q_parse_configs(spark: SparkSession, sf: str) -> DataFrame:
    configs = parse_configs(t.config_texts(spark, sf))
    return configs.withColumn("download_pdf", F.col("download_pdf").cast("string"))


_PARSED = f"""WITH {t.CONFIGS}
SELECT path, readable AND format <> 'invalid' AS readable,
       CASE WHEN readable AND format <> 'invalid' THEN query_str END AS query_str,
       CASE WHEN readable THEN author END AS author,
       CASE WHEN readable AND format <> 'invalid' THEN CAST(download_pdf AS VARCHAR) END
         AS download_pdf
FROM parsed"""


def _validated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    configs = parse_configs(t.config_texts(spark, sf))
    return validate_configs(configs, t.metadata_files(spark, sf), t.ROOT)


def q_valid_configs(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf)[0]


REQUESTS_SQL = f"""WITH {t.CONFIGS}
SELECT project, path, destination, replace(query_str, '''', '"') AS query_str,
       coalesce(author, 'Anonymous') AS author, download_pdf
FROM checked WHERE reason IS NULL"""


def q_rejected_configs(spark: SparkSession, sf: str) -> DataFrame:
    return _validated(spark, sf)[1]


REJECTS_SQL = f"WITH {t.CONFIGS} SELECT project, path, reason FROM checked WHERE reason IS NOT NULL"


def q_config_stages(spark: SparkSession, sf: str) -> DataFrame:
    configs = parse_configs(t.config_texts(spark, sf))
    return config_stages(checked_configs(configs, t.metadata_files(spark, sf), t.ROOT))


STAGES_SQL = f"""WITH {t.CONFIGS},
staged AS (
  SELECT project, path, reason,
         CASE reason WHEN 'config_missing' THEN ['config_missing']
                     WHEN 'config_bad_format' THEN ['config_bad_format', 'config_unreadable']
                     WHEN 'config_unreadable' THEN ['config_bad_format']
                     WHEN 'destination_exists' THEN ['config_received', 'destination_exists']
                     WHEN 'empty_query' THEN ['config_received', 'config_parsed', 'failed']
                     ELSE ['config_received', 'config_parsed'] END AS stages
  FROM checked)
SELECT project, path, reason, CAST(generate_subscripts(stages, 1) - 1 AS INTEGER) AS step,
       unnest(stages) AS stage FROM staged"""


def _written_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Configs written as files in all formats and read back, their paths from the project on."""
    folder = shared_dir(spark, "configs")
    t.named_files(t.source_configs(spark, sf), folder)
    configs = read_query_configs(spark, folder)
    return configs.withColumn("path", F.regexp_extract("path", r"([^/]+/config/[^/]+)\z", 1))


def q_read_query_configs(spark: SparkSession, sf: str) -> DataFrame:
    return _written_configs(spark, sf).withColumn("download_pdf", F.col("download_pdf").cast("string"))


_READ_CONFIGS = f"""WITH {t.SOURCE_CONFIGS}
SELECT path, readable, query_str, author, CAST(download_pdf AS VARCHAR) AS download_pdf
FROM source_configs WHERE suffix <> '.txt'"""


def q_claimed_configs(spark: SparkSession, sf: str) -> DataFrame:
    """Several configs want one destination: the first that can run gets it."""
    configs = _written_configs(spark, sf).withColumn("path", F.concat(F.lit(f"{t.ROOT}/"), "path"))
    none = spark.createDataFrame([], "path string")
    return checked_configs(configs, none, t.ROOT).select("path", "destination", "reason")


_CLAIMED = f"""WITH {t.SOURCE_CONFIGS},
alone AS (
  SELECT *, CASE WHEN suffix IN ('.yml', '.txt') THEN 'config_bad_format'
                 WHEN NOT readable THEN 'config_unreadable' END AS reason
  FROM source_configs WHERE suffix <> '.txt')
SELECT '{t.ROOT}/' || path AS path,
       CASE WHEN suffix IN ('.json', '.yaml', '.bib') THEN '{t.ROOT}/' || destination END AS destination,
       CASE WHEN reason IS NULL AND path > min(path) FILTER (reason IS NULL) OVER (PARTITION BY destination)
            THEN 'destination_exists' ELSE reason END AS reason
FROM alone"""


def q_bib_entries(spark: SparkSession, sf: str) -> DataFrame:
    return split_entries(t.bib_chunks(spark, sf))


_ENTRIES = f"WITH {t.BIB} SELECT * FROM entries"


def q_read_bib_files(spark: SparkSession, sf: str) -> DataFrame:
    """The bibliography written out and read back."""
    path = shared_dir(spark, "bib")
    t.bib_chunks(spark, sf).write.partitionBy("file_name").text(path)
    return read_bib_entries(spark, path).select("pos", "pmid", "url")


_BIB_FILES = f"WITH {t.BIB} SELECT pos, pmid, url FROM entries"


def q_build_query(spark: SparkSession, sf: str) -> DataFrame:
    return build_query(split_entries(t.bib_chunks(spark, sf)), download_pdf=True)


_BUILD = f"""WITH {t.BIB},
ids AS (
  SELECT file_name, pos, 0 AS k, pmid AS id FROM entries WHERE pmid IS NOT NULL
  UNION ALL
  SELECT file_name, pos, 1, string_split(url, '/')[-1] FROM entries WHERE contains(url, 'pubmed')),
files AS (SELECT DISTINCT file_name FROM entries)
SELECT file_name,
       coalesce(string_agg(id, ' OR ' ORDER BY pos, k), '') AS query_str,
       true AS download_pdf
FROM files LEFT JOIN ids USING (file_name) GROUP BY file_name"""


def q_resolve_iframe(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("page_id") % 3
    rest = F.substring_index("url", "://", -1)
    frame = (
        F.when(third == 0, F.concat(F.lit('<iframe id="x>1" src="'), "url", F.lit('"></iframe>')))
        .when(third == 1, F.concat(F.lit("<IFRAME data-src='no' SRC='//"), rest, F.lit("' ></IFRAME>")))
        .otherwise("<!-- <iframe src='no'></iframe> -->")
    )
    return _pages(spark, sf).select("page_id", resolve_iframe(F.concat("html", frame)).alias("source"))


_IFRAME = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
  WHEN 1 THEN 'http://' || string_split(url, '://')[-1] END AS source FROM pages"""


def _with_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.when(
        F.col("page_id") % 4 != 0,
        F.concat(
            F.lit("<a class='x int-view' href='/pdf/"),
            "page_id",
            F.lit("?a=1&amp;b=2'>PDF</a><A HREF=/articles/"),
            "page_id",
            F.lit(" class=int-view>again</A><a class=\"int-view\" href=\"/articles/"),
            "page_id",
            F.lit('">twice</a><a class="int-viewer" href="/a">no</a>'),
        ),
    ).otherwise("<p>int-view</p>")
    return _pages(spark, sf).select("page_id", F.concat("html", links).alias("html"))


def q_extract_pdf_link(spark: SparkSession, sf: str) -> DataFrame:
    return _with_links(spark, sf).select("page_id", extract_pdf_link(F.col("html")).alias("link"))


_LINK = """SELECT page_id, CASE WHEN page_id % 4 <> 0
  THEN 'https://www.ncbi.nlm.nih.gov/articles/' || page_id END AS link FROM pages"""


def q_distinct_links(spark: SparkSession, sf: str) -> DataFrame:
    links = distinct_links(F.col("html"), "int-view")
    return _with_links(spark, sf).select("page_id", F.explode(links).alias("link"))


_LINKS = """SELECT page_id, unnest(['/pdf/' || page_id || '?a=1&b=2', '/articles/' || page_id]) AS link
FROM pages WHERE page_id % 4 <> 0"""


def _result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Search pages: a PDF block, a title only, a table, no link; some captchas."""

    def title(inner: Column) -> Column:
        return F.concat(F.lit('<div class="gs_ri"><h3 class="gs_rt">'), inner, F.lit("</h3></div>"))

    def linked(text: str) -> Column:
        return F.concat(F.lit('<a id="t" href="'), "url", F.lit(f'">{text} <b>'), "page_id", F.lit("</b> &amp; more</a>"))

    blocks = F.concat(
        F.lit('<div class="gs_r gs_or"><div class="gs_ggs gs_fl"><div><a href="'),
        "url",
        F.lit('.pdf">PDF</a></div></div>'),
        title(linked("Full")),
        F.lit('</div><div data-x="1" class="gs_r">'),
        title(linked("Title")),
        F.lit('</div><div class="gs_r"><table><tr><td>x</td></tr></table>'),
        title(linked("Table")),
        F.lit("</div><div class='gs_r'>"),
        title(F.lit("No link")),
        F.lit('</div><div class="foot"><table><tr><td>after</td></tr></table></div>'),
    )
    tail = F.when(F.col("page_id") % 10 == 0, "<p>CAPTCHA</p>").otherwise(blocks)
    query = F.concat(F.lit("q"), F.col("page_id") % 7)
    return _pages(spark, sf).select("page_id", query.alias("query"), F.concat("html", tail).alias("html"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    found = extract_search_results(F.col("html"), F.col("query"))
    return _result_pages(spark, sf).select("page_id", "query", found.alias("r"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return result_rows(_result_pages(spark, sf).withColumnRenamed("page_id", "page"))


def q_search_results(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf)


_RESULT_ROWS = """
results AS (
  SELECT page_id AS page, 'q' || (page_id % 7) AS query, CAST(pos AS INTEGER) AS pos,
         CASE pos WHEN 0 THEN 'Full ' ELSE 'Title ' END || page_id || ' & more' AS name,
         CASE pos WHEN 0 THEN url || '.pdf' ELSE url END AS url
  FROM (SELECT *, unnest([0, 1]) AS pos FROM pages WHERE page_id % 10 <> 0))"""

_RESULTS = f"WITH {_RESULT_ROWS} SELECT * FROM results"


def q_search_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", "r.err", F.size("r.papers").alias("papers"))


_ERRORS = """SELECT page_id, CASE WHEN page_id % 10 = 0
  THEN 'Failed to complete search with query q' || (page_id % 7) || ' (captcha)' END AS err,
  CASE WHEN page_id % 10 = 0 THEN 0 ELSE 2 END AS papers FROM pages"""


def q_limit_results(spark: SparkSession, sf: str) -> DataFrame:
    return limit_results(_results(spark, sf))


_LIMIT = f"""WITH {_RESULT_ROWS}
SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY query ORDER BY page, pos) <= 10"""


def q_limit_many_results(spark: SparkSession, sf: str) -> DataFrame:
    """A limit above what is cut before the shuffle: hits per order status."""
    hits = t.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("query"), F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos")
    )
    return limit_results(hits, 2_000)


_LIMIT_MANY = """SELECT query, page, pos FROM (
  SELECT o_orderstatus AS query, o_custkey AS page, o_orderkey AS pos,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS place
  FROM orders) WHERE place <= 2000"""


def q_embed_style(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)<head>.*?</head>", "")
    return _pages(spark, sf).select(
        "page_id",
        embed_style(F.col("html"), t.CSS).alias("styled"),
        embed_style(bare, t.CSS).alias("styled_bare"),
    )


_STYLE = f"""SELECT page_id, replace(html, '</head>', '<style>{t.CSS}</style></head>') AS styled,
  '<head><style>{t.CSS}</style></head>' || regexp_replace(html, '(?is)<head>.*?</head>', '') AS styled_bare
FROM pages"""


QUERIES = {
    "normalize_query": (q_normalize_query, _NORMALIZE),
    "classify_identifier": (q_classify_identifier, _CLASSIFY),
    "document_name": (q_document_name, _NAMES),
    "pmid_from_url": (q_pmid_from_url, _FROM_URL),
    "slug": (q_slug, _SLUG),
    "config_format": (q_config_format, _FORMAT),
    "parse_configs": (q_parse_configs, _PARSED),
    "valid_configs": (q_valid_configs, REQUESTS_SQL),
    "rejected_configs": (q_rejected_configs, REJECTS_SQL),
    "config_stages": (q_config_stages, STAGES_SQL),
    "read_query_configs": (q_read_query_configs, _READ_CONFIGS),
    "claimed_configs": (q_claimed_configs, _CLAIMED),
    "bib_entries": (q_bib_entries, _ENTRIES),
    "read_bib_files": (q_read_bib_files, _BIB_FILES),
    "build_query": (q_build_query, _BUILD),
    "resolve_iframe": (q_resolve_iframe, _IFRAME),
    "extract_pdf_link": (q_extract_pdf_link, _LINK),
    "distinct_links": (q_distinct_links, _LINKS),
    "search_results": (q_search_results, _RESULTS),
    "search_errors": (q_search_errors, _ERRORS),
    "limit_results": (q_limit_results, _LIMIT),
    "limit_many_results": (q_limit_many_results, _LIMIT_MANY),
    "embed_style": (q_embed_style, _STYLE),
}
