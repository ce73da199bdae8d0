"""Queries over article records, duplicates and full texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.bindings import tables as t
from citeloom.operators.dedup import (
    dedup_tally,
    duplicated_articles,
    first_file,
    new_pmids,
    unique_key_lookup,
    valid_pmids,
    with_key,
)
from citeloom.operators.enrich import (
    enrich_journal,
    project_articles,
    rejected_articles,
    with_enrichment,
)
from citeloom.operators.firstfiles import Index, build_index, merged_index, new_pmids_by_index, tally_by_index
from citeloom.operators.fulltext import fetch_plan, pending_conversions, update_fulltext
from citeloom.operators.history import run_summary
from citeloom.operators.hotkeys import split_join
from citeloom.operators.paging import concat_pages, page_plan
from citeloom.operators.running import running_total
from citeloom.plans.metadata import MetadataRun, commit_metadata_run, metadata_run
from citeloom.schemas import HISTORY
from citeloom.sources.articles import (
    append_history,
    duplicates_path,
    read_article_files,
    read_written_articles,
    write_articles,
    write_csv,
    write_documents,
    write_duplicates,
)
from citeloom.sources.files import file_inventory, new_files
from citeloom.sources.inventory import present_files, record_listing
from citeloom.sources.runs import read_committed_articles
from citeloom.storage import shared_dir
from citeloom.streaming.jobs import append_sink

_SHOWN = """tag, pmid, pmcid, pmc_link, pubmed_link, abstract, title, imported_date, authors,
  journal_abbr, journal, pdf, html, impact_factor, publication, doi, doi_link"""


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return project_articles(t.raw_articles(spark, sf), t.RUN_DATE, t.TAG)


def q_new_pmids(spark: SparkSession, sf: str) -> DataFrame:
    return new_pmids(t.incoming_ids(spark, sf), t.earlier_articles(spark, sf))


_NEW = f"""WITH {t.INCOMING}, {t.EARLIER}
SELECT pmid FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.pmid <> 0 AND e.pmid = i.pmid)"""


def q_duplicated_articles(spark: SparkSession, sf: str) -> DataFrame:
    return duplicated_articles(t.incoming_ids(spark, sf), t.earlier_articles(spark, sf))


_HELD = f"""{t.INCOMING}, {t.EARLIER},
held AS (
  SELECT *, dense_rank() OVER (PARTITION BY pmid ORDER BY file_name) AS place
  FROM earlier
  WHERE pmid <> 0 AND pmid IN (SELECT pmid FROM incoming))"""

_DUPLICATES = f"""WITH {_HELD}
SELECT pmid, file_name, line, part, supp FROM held WHERE place = 1"""


def q_first_file(spark: SparkSession, sf: str) -> DataFrame:
    (earlier,) = with_key(valid_pmids(t.earlier_articles(spark, sf)))
    return first_file(earlier).select(
        F.col("_pmid_key").alias("pmid"), "file_name", F.col("_records").alias("records")
    )


_FIRST_FILE = f"""WITH {t.EARLIER}
SELECT pmid, file_name, count(*) AS records
FROM (SELECT *, dense_rank() OVER (PARTITION BY pmid ORDER BY file_name) AS place
      FROM earlier WHERE pmid <> 0)
WHERE place = 1 GROUP BY pmid, file_name"""


def q_dedup_tally(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_tally(t.incoming_ids(spark, sf), t.earlier_articles(spark, sf))


_TALLY = f"""WITH {_HELD},
firsts AS (SELECT DISTINCT pmid, file_name FROM held WHERE place = 1),
gone AS (SELECT file_name, count(*) AS n FROM firsts JOIN incoming USING (pmid) GROUP BY file_name),
found AS (SELECT file_name, count(*) AS n FROM held WHERE place = 1 GROUP BY file_name),
files AS (SELECT DISTINCT file_name FROM earlier)
SELECT file_name, coalesce(found.n, 0) AS duplicated_records, coalesce(gone.n, 0) AS removed_ids,
       CAST((SELECT count(*) FROM incoming)
            - sum(coalesce(gone.n, 0)) OVER (ORDER BY file_name) AS BIGINT) AS ids_left
FROM files LEFT JOIN found USING (file_name) LEFT JOIN gone USING (file_name)"""


def _index(spark: SparkSession, sf: str) -> Index:
    """The index of all earlier records, merged from two runs, the later files first."""
    earlier = t.earlier_articles(spark, sf)
    return merged_index(build_index(earlier.where("file_name >= 'N'")), earlier.where("file_name < 'N'"))


def q_new_pmids_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return new_pmids_by_index(t.incoming_ids(spark, sf), _index(spark, sf))


def q_tally_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return tally_by_index(t.incoming_ids(spark, sf), _index(spark, sf), t.earlier_articles(spark, sf))


def q_valid_pmids(spark: SparkSession, sf: str) -> DataFrame:
    return valid_pmids(t.earlier_articles(spark, sf))


_VALID = f"WITH {t.EARLIER} SELECT * FROM earlier WHERE pmid IS NOT NULL AND pmid <> 0"


def q_unique_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that are the only one with their balance in whole hundreds."""
    customers = t.table(spark, sf, "customer").select(
        F.concat_ws("-", "c_nationkey", F.floor(F.col("c_acctbal") / 10)).alias("key"),
        "c_custkey",
        "c_name",
    )
    return unique_key_lookup(customers, "key")


_UNIQUE = """SELECT key, min(c_custkey) AS c_custkey, min(c_name) AS c_name
FROM (SELECT c_nationkey || '-' || CAST(floor(c_acctbal / 10) AS BIGINT) AS key, c_custkey, c_name
      FROM customer) GROUP BY key HAVING count(*) = 1"""


_PROJECT = f"WITH {t.ARTICLES} SELECT {_SHOWN} FROM articles"


def q_rejected_articles(spark: SparkSession, sf: str) -> DataFrame:
    return rejected_articles(t.raw_articles(spark, sf)).select("pmid", "title", "reason")


_REJECTED = f"""WITH {t.RAW_ARTICLES}
SELECT pmid, title, 'authors are missing' AS reason FROM raw WHERE authors IS NULL"""


def q_enrich_journal(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_journal(_articles(spark, sf), t.journal_factors(spark, sf)).select(
        "pmid", "journal_abbr", "journal", "impact_factor"
    )


_KNOWN = """
known AS (
  SELECT lower(key) AS key, min(factor) AS factor, min(journal) AS journal
  FROM factors GROUP BY lower(key) HAVING count(*) = 1)"""

_ENRICH = f"""WITH {t.ARTICLES}, {t.FACTORS}, {_KNOWN}
SELECT pmid, journal_abbr, coalesce(k.journal, 'Unknown') AS journal,
       coalesce(k.factor, -1) AS impact_factor
FROM articles a LEFT JOIN known k ON k.key = lower(a.journal_abbr)"""


def q_pluggable_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """The caller's own function: a factor from the length of the abstract."""

    def by_length(articles: DataFrame) -> DataFrame:
        return articles.withColumn("impact_factor", F.length("abstract").cast("double"))

    plain = _articles(spark, sf)
    return with_enrichment(plain, by_length).select("pmid", "impact_factor").join(
        with_enrichment(plain).select("pmid", F.col("impact_factor").alias("default_factor")), "pmid"
    )


_PLUGGABLE = f"""WITH {t.ARTICLES}
SELECT pmid, CAST(length(abstract) AS DOUBLE) AS impact_factor,
       impact_factor AS default_factor FROM articles"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    hits = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pmid"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("filename")
    )
    runs = hits.select("filename").distinct().withColumn("query_str", F.concat(F.lit("in "), "filename"))
    kept = new_pmids(hits, t.earlier_articles(spark, sf))
    return run_summary(hits, kept, runs, F.lit(t.RUN_DATE))


_SUMMARY = f"""WITH {t.EARLIER},
hits AS (SELECT o_orderkey AS pmid, 'y' || year(o_orderdate) AS filename FROM orders),
kept AS (SELECT filename, count(*) AS n FROM hits
         WHERE pmid NOT IN (SELECT pmid FROM earlier WHERE pmid <> 0) GROUP BY filename)
SELECT '{t.RUN_DATE}' AS time, 'in ' || filename AS query_str, count(*) AS total_articles,
       count(*) - coalesce(max(n), 0) AS duplicated_articles,
       coalesce(max(n), 0) AS valid_articles, filename
FROM hits LEFT JOIN kept USING (filename) GROUP BY filename"""


def q_append_history(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "history")
    summary = _runs(spark, sf)
    even = F.right("filename", F.lit(1)).cast("int") % 2 == 0
    append_history(summary.where(even), path)
    append_history(summary.where(~even), path)
    return spark.read.parquet(path)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders")
    by_status = orders.groupBy(F.col("o_orderstatus").alias("query")).agg(F.count("*").alias("n"))
    by_day = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("query")).agg(
        F.count("*").alias("n")
    )
    return by_status.unionByName(by_day)


def q_page_plan(spark: SparkSession, sf: str) -> DataFrame:
    return page_plan(_counts(spark, sf))


_COUNTS = """
counts AS (
  SELECT o_orderstatus AS query, count(*) AS n FROM orders GROUP BY 1
  UNION ALL
  SELECT strftime(o_orderdate, '%Y-%m') AS query, count(*) AS n FROM orders GROUP BY 1)"""

_PAGES = f"""WITH {_COUNTS}
SELECT query, n, page, page * 250 AS "offset"
FROM (SELECT query, n, unnest(generate_series(0, n // 250)) AS page FROM counts)"""


def q_concat_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 250 hits at most by status, put together; some pages come twice."""
    page = F.floor(F.col("o_orderkey") / 250)
    orders = t.table(spark, sf, "orders").select("o_orderstatus", page.alias("page"), "o_orderkey")
    pages = orders.groupBy("o_orderstatus", "page").agg(F.collect_list("o_orderkey").alias("ids"))
    twice = F.when(F.col("page") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return concat_pages(pages.withColumn("copy", F.explode(twice)).drop("copy"))


_CONCAT = """SELECT o_orderstatus, o_orderkey // 250 AS page, o_orderkey AS pmid FROM orders
UNION ALL SELECT o_orderstatus, o_orderkey // 250, o_orderkey FROM orders
WHERE o_orderkey // 250 % 3 = 0"""


def q_update_fulltext(spark: SparkSession, sf: str) -> DataFrame:
    updated = update_fulltext(_articles(spark, sf), t.pdf_files(spark, sf), t.PDF_BASE, t.HTML_BASE)
    return updated.select("pmid", "title", "pdf", "html")


_UPDATE = f"""WITH {t.ARTICLES}, {t.FILES}
SELECT pmid, title,
       CASE WHEN pmid || '.pdf' IN (SELECT name FROM pdfs)
            THEN '<embed src=''{t.PDF_BASE}/' || pmid
                 || '.pdf'' width=''100%'' height=''600px'' type=''application/pdf''>'
            ELSE pdf END AS pdf,
       '{t.HTML_BASE}/' || pmid || '.html' AS html
FROM articles"""


def q_pending_conversions(spark: SparkSession, sf: str) -> DataFrame:
    return pending_conversions(t.pdf_files(spark, sf), t.html_files(spark, sf))


_PENDING = f"""WITH {t.FILES}
SELECT name FROM pdfs WHERE replace(name, '.pdf', '.html') NOT IN (SELECT name FROM htmls)"""


def _all_articles(spark: SparkSession, sf: str) -> DataFrame:
    raw = t.raw_articles(spark, sf)
    return raw.select(
        F.col("pmid").cast("bigint").alias("pmid"),
        F.coalesce("pmc", F.lit("")).alias("pmcid"),
        F.coalesce("doi", F.lit("")).alias("doi"),
    )


def q_fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_plan(_all_articles(spark, sf), t.pdf_files(spark, sf), t.html_files(spark, sf))


_FETCH = f"""WITH {t.RAW_ARTICLES}, {t.FILES}
SELECT CAST(pmid AS BIGINT) AS pmid, coalesce(pmc, '') AS pmcid, coalesce(doi, '') AS doi,
       CASE WHEN pmid || '.pdf' IN (SELECT name FROM pdfs)
            THEN CASE WHEN pmid || '.html' IN (SELECT name FROM htmls) THEN 'update' ELSE 'convert' END
            WHEN pmc IS NOT NULL THEN 'pmc' WHEN doi IS NOT NULL THEN 'doi' ELSE 'none' END AS action
FROM raw"""


def q_metadata_run(spark: SparkSession, sf: str) -> DataFrame:
    """All documents asked for, those with a page already held."""
    incoming = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"))
    held = t.table(spark, sf, "pages").select(
        F.col("page_id").alias("pmid"), F.lit("held.json").alias("file_name")
    )
    run = metadata_run(
        incoming,
        t.raw_articles(spark, sf),
        held,
        t.RUN_DATE,
        "new.json",
        "all",
        t.TAG,
        lambda df: enrich_journal(df, t.journal_factors(spark, sf)),
    )
    return run.articles


_RUN = f"""WITH {t.ARTICLES}, {t.FACTORS}, {_KNOWN}
SELECT a.* REPLACE (coalesce(k.journal, 'Unknown') AS journal,
                    coalesce(k.factor, -1) AS impact_factor)
FROM articles a LEFT JOIN known k ON k.key = lower(a.journal_abbr)
WHERE pmid = 0 OR pmid NOT IN (SELECT page_id FROM pages)"""


def _run_outputs(spark: SparkSession, sf: str):
    """Ids of all documents and of some without an article; every third is held, some twice."""
    documents = t.table(spark, sf, "documents").select("doc_id")
    incoming = documents.selectExpr("CAST(doc_id AS STRING) AS pmid").unionAll(
        documents.where("doc_id % 10 = 1").selectExpr("CAST(doc_id + 1000000000 AS STRING)")
    )
    held = documents.where("doc_id % 3 = 1").selectExpr("doc_id AS pmid", "'a.json' AS file_name")
    held = held.unionAll(documents.where("doc_id % 6 = 1").selectExpr("doc_id", "'b.json'"))
    raw = t.raw_articles(spark, sf)
    return metadata_run(incoming, raw, held, t.RUN_DATE, "new.json", "all", t.TAG)


def q_metadata_run_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _run_outputs(spark, sf).rejects.select("pmid", "reason")


def q_metadata_run_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _run_outputs(spark, sf).duplicates


def q_metadata_run_history(spark: SparkSession, sf: str) -> DataFrame:
    return _run_outputs(spark, sf).history


_REJECTS_OF_RUN = f"""WITH {t.ARTICLES}
SELECT pmid, 'authors are missing' AS reason FROM raw
WHERE authors IS NULL AND CAST(pmid AS BIGINT) % 3 <> 1
UNION ALL SELECT CAST(doc_id + 1000000000 AS VARCHAR), 'no article was fetched'
FROM documents WHERE doc_id % 10 = 1"""
_REPEATS_OF_RUN = """SELECT doc_id AS pmid, 'a.json' AS file_name FROM documents WHERE doc_id % 3 = 1"""
_HISTORY_OF_RUN = f"""SELECT '{t.RUN_DATE}' AS time, 'all' AS query_str,
       count(*) + count(*) FILTER (doc_id % 10 = 1) AS total_articles,
       count(*) FILTER (doc_id % 3 = 1) AS duplicated_articles,
       count(*) FILTER (doc_id % 3 <> 1) + count(*) FILTER (doc_id % 10 = 1) AS valid_articles,
       'new.json' AS filename FROM documents"""


def q_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a second run over all documents fetches and repeats, by collection.

    The first run fetched the even documents; its collection and one with
    repeats beside it are all that the second run finds.
    """
    folder = shared_dir(spark, "runs")
    articles = _articles(spark, sf)
    write_articles(articles.where("pmid % 2 = 0"), f"{folder}/first.json")
    write_duplicates(articles.where("pmid % 2 = 1 AND pmid % 7 = 0"), f"{folder}/first.json")
    earlier = read_written_articles(spark, folder)
    incoming = articles.select("pmid")
    repeats = duplicated_articles(incoming, earlier).select("pmid", "file_name")
    fresh = new_pmids(incoming, earlier).select("pmid", F.lit("").alias("file_name"))
    return repeats.unionAll(fresh)


def q_committed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same from runs that are committed as a whole; one that broke off is not seen."""
    base = shared_dir(spark, "committed")
    articles = _articles(spark, sf)
    history = spark.createDataFrame([], HISTORY)
    first = MetadataRun(
        articles.where("pmid % 2 = 0"), articles.limit(0), articles.where("pmid % 2 = 1 AND pmid % 7 = 0"), history
    )
    commit_metadata_run(first, base, "p/metadata/first.json", "r1")
    articles.write.parquet(f"{base}/articles/run=r2")
    earlier = read_committed_articles(spark, base)
    incoming = articles.select("pmid")
    repeats = duplicated_articles(incoming, earlier).select("pmid", "file_name")
    fresh = new_pmids(incoming, earlier).select("pmid", F.lit("").alias("file_name"))
    return repeats.unionAll(fresh)


_SECOND = f"""WITH {t.ARTICLES}
SELECT pmid, CASE WHEN pmid % 2 = 0 AND pmid <> 0 THEN 'first.json'
                  WHEN pmid % 7 = 0 AND pmid <> 0 THEN 'first_duplicated' ELSE '' END AS file_name
FROM articles"""


def _written_articles(spark: SparkSession, sf: str) -> str:
    path = shared_dir(spark, "articles")
    write_articles(_articles(spark, sf), path, "json_array")
    return path


def q_read_article_files(spark: SparkSession, sf: str) -> DataFrame:
    path = _written_articles(spark, sf)
    return read_article_files(spark, path, pattern="part-*").drop("file_name")


def q_read_article_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = _written_articles(spark, sf)
    return read_article_files(spark, path, "lines", "part-*").drop("file_name")


def q_read_article_splits(spark: SparkSession, sf: str) -> DataFrame:
    path = _written_articles(spark, sf)
    return read_article_files(spark, path, "split", "part-*").drop("file_name")


def q_write_articles(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "table")
    write_articles(_articles(spark, sf), path)
    return spark.read.parquet(path)


def q_write_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    write_csv(t.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    schema = "c_custkey bigint, c_name string, c_mktsegment string"
    return spark.read.schema(schema).option("header", True).csv(path)


_CSV = "SELECT c_custkey, c_name, c_mktsegment FROM customer"


def q_write_documents(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "documents")
    pages = t.table(spark, sf, "pages").select(
        F.concat("page_id", F.lit(".pdf")).alias("name"), "url", F.encode("html", "UTF-8").alias("content")
    )
    write_documents(pages, path)
    stored = spark.read.parquet(path)
    return stored.select("name", "url", "md5", F.length("content").cast("bigint").alias("bytes"))


_DOCUMENTS = """SELECT page_id || '.pdf' AS name, url, md5(html) AS md5,
       CAST(strlen(html) AS BIGINT) AS bytes FROM pages"""


def q_write_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    destination = shared_dir(spark, "result") + ".json"
    repeats = q_duplicated_articles(spark, sf)
    write_duplicates(repeats, destination)
    return spark.read.parquet(duplicates_path(destination))


def _segment_folder(spark: SparkSession, sf: str) -> str:
    """A folder of files with the customers' names, by segment."""
    path = shared_dir(spark, "files")
    customers = t.table(spark, sf, "customer").select("c_mktsegment", "c_name")
    customers.write.partitionBy("c_mktsegment").text(path)
    return path


def _segment_sizes(files: DataFrame) -> DataFrame:
    segment = F.regexp_extract("path", r"c_mktsegment=([^/]+)/", 1)
    return files.groupBy(segment.alias("segment")).agg(F.sum("length").alias("bytes"))


def q_file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _segment_sizes(file_inventory(spark, _segment_folder(spark, sf), ".txt"))


def q_inventory_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder by a log: one segment listed first, then all, a segment gone in between."""
    folder, log = _segment_folder(spark, sf), shared_dir(spark, "inventory")
    base = file_inventory(spark, folder, ".txt").agg(F.min("path")).first()[0].split("/c_mktsegment=")[0]
    part = f"{base}/c_mktsegment=BUILDING"
    record_listing(spark, log, [part], 1, ".txt")
    # What the log holds of a folder that is no longer there goes with its next listing.
    lost = [("gone.txt", f"{base}/lost/gone.txt")]
    gone = spark.createDataFrame(lost, "name string, path string").selectExpr("path", "name", "7L AS length", "true AS present")
    gone.write.parquet(f"{log}/listing=2")
    record_listing(spark, log, [base], 3, ".txt")
    return _segment_sizes(present_files(spark, log))


def q_new_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder taken up by the file stream."""
    out = shared_dir(spark, "new-files")
    files = new_files(spark, _segment_folder(spark, sf)).where("path LIKE '%.txt'")
    append_sink(files, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return _segment_sizes(spark.read.parquet(f"{out}/table"))


_INVENTORY = """SELECT c_mktsegment AS segment, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes
FROM customer GROUP BY c_mktsegment"""


def q_split_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of frequent parts spread over salts; large parts are in the lookup."""
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"))
    parts = t.table(spark, sf, "part").where("p_size > 25")
    lookup = parts.select(F.col("p_partkey").alias("part"), "p_name")
    return split_join(rows, lookup, ["part"], "left", hot_rows=30)


_SPLIT = """SELECT l_orderkey, l_linenumber, l_partkey AS part, p_name
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON p_partkey = l_partkey"""


def q_running_total(spark: SparkSession, sf: str) -> DataFrame:
    """Orders up to each one, by their key as text."""
    orders = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("name"), (F.col("o_custkey") % 7).alias("n")
    )
    return running_total(orders, "name", "n", "so_far")


_RUNNING = """SELECT name, n, CAST(sum(n) OVER (ORDER BY name) AS BIGINT) AS so_far
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_custkey % 7 AS n FROM orders)"""


QUERIES = {
    "split_join": (q_split_join, _SPLIT),
    "running_total": (q_running_total, _RUNNING),
    "new_pmids": (q_new_pmids, _NEW),
    "duplicated_articles": (q_duplicated_articles, _DUPLICATES),
    "new_pmids_by_index": (q_new_pmids_by_index, _NEW),
    "tally_by_index": (q_tally_by_index, _TALLY),
    "dedup_tally": (q_dedup_tally, _TALLY),
    "valid_pmids": (q_valid_pmids, _VALID),
    "unique_key_lookup": (q_unique_key_lookup, _UNIQUE),
    "project_articles": (_articles, _PROJECT),
    "rejected_articles": (q_rejected_articles, _REJECTED),
    "enrich_journal": (q_enrich_journal, _ENRICH),
    "pluggable_enrichment": (q_pluggable_enrichment, _PLUGGABLE),
    "run_summary": (_runs, _SUMMARY),
    "append_history": (q_append_history, _SUMMARY),
    "page_plan": (q_page_plan, _PAGES),
    "concat_pages": (q_concat_pages, _CONCAT),
    "update_fulltext": (q_update_fulltext, _UPDATE),
    "pending_conversions": (q_pending_conversions, _PENDING),
    "fetch_plan": (q_fetch_plan, _FETCH),
    "metadata_run_rejects": (q_metadata_run_rejects, _REJECTS_OF_RUN),
    "metadata_run_duplicates": (q_metadata_run_duplicates, _REPEATS_OF_RUN),
    "metadata_run_history": (q_metadata_run_history, _HISTORY_OF_RUN),
    "second_run": (q_second_run, _SECOND),
    "metadata_run": (q_metadata_run, _RUN),
    "read_article_files": (q_read_article_files, _PROJECT),
    "read_article_lines": (q_read_article_lines, _PROJECT),
    "read_article_splits": (q_read_article_splits, _PROJECT),
    "write_articles": (q_write_articles, _PROJECT),
    "write_csv": (q_write_csv, _CSV),
    "write_documents": (q_write_documents, _DOCUMENTS),
    "committed_runs": (q_committed_runs, _SECOND),
    "write_duplicates": (q_write_duplicates, _DUPLICATES),
    "file_inventory": (q_file_inventory, _INVENTORY),
    "inventory_log": (q_inventory_log, _INVENTORY),
    "new_files": (q_new_files, _INVENTORY),
    "first_file": (q_first_file, _FIRST_FILE),
}
