import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from citeloom.operators.enrich import enrich_journal, project_articles, rejected_articles
from citeloom.operators.fulltext import fetch_plan, pending_conversions, update_fulltext
from citeloom.operators.history import run_summary
from citeloom.operators.paging import limit_results, page_plan
from citeloom.plans.fulltext import fulltext_run
from citeloom.plans.metadata import commit_metadata_run, metadata_run, write_metadata_run
from citeloom.schemas import ARTICLE, RAW_ARTICLE
from citeloom.sources.articles import duplicates_path
from citeloom.sources.runs import read_committed_articles, read_history
from tests.helpers import plan_text, rows


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            ("1", "PMC9", "a\nb", "T", ["X Y", "Z"], "J One", "2020", "10.1/a"),
            ("2", None, None, None, [], "j two", None, None),
            ("3", "", "", "U", ["X"], "J Three", "2021", ""),
            ("x4", None, None, "bad id", ["X"], "J One", "2021", None),
            ("5", None, None, "no authors", None, "J One", "2021", None),
            ("6", None, None, "null author", ["X", None], "J One", "2021", None),
        ],
        RAW_ARTICLE,
    )


def test_project_articles(raw):
    got = project_articles(raw, "2024-01-01")
    assert [f.simpleString() for f in got.schema] == [f.simpleString() for f in ARTICLE]
    one, two, three = sorted(got.collect(), key=lambda r: r.pmid)
    assert (one.tag, one.authors, one.abstract) == ("Anonymous", "X Y, Z", "a b")
    assert one.pmc_link.endswith("/pmc/articles/PMC9") and one.pubmed_link.endswith("gov/1")
    assert (two.pmcid, two.pmc_link, two.abstract, two.title, two.authors) == ("", "", "", None, "")
    assert two.doi_link == three.doi_link == "https://doi.org/"
    assert (one.journal, one.impact_factor, one.imported_date) == ("Unknown", -1.0, "2024-01-01")


def test_rejected_articles(raw):
    assert rows(rejected_articles(raw), "pmid", "reason") == [
        ("5", "authors are missing"),
        ("6", "authors are missing"),
        ("x4", "pmid is not a number"),
    ]


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_enrich_journal(spark, raw, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    factors = spark.createDataFrame(
        [("j one", 2.5, "JOURNAL ONE"), ("J Two", 1.0, "A"), ("J TWO", 2.0, "B")],
        "key string, factor double, journal string",
    )
    got = enrich_journal(project_articles(raw, "d"), factors)
    assert rows(got, "pmid", "journal", "impact_factor") == [
        (1, "JOURNAL ONE", 2.5),
        (2, "Unknown", -1.0),
        (3, "Unknown", -1.0),
    ]
    assert got.columns == ARTICLE.fieldNames()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_fetch_plan_and_update(spark):
    articles = spark.createDataFrame(
        [(1, "", "", "old", ""), (2, "", "d", "", ""), (3, "P", "d", "", ""), (4, "", "d", "", ""),
         (5, "", "", "old", ""), (1, "", "", "", "")],
        "pmid bigint, pmcid string, doi string, pdf string, html string",
    )
    pdfs, htmls = _names(spark, "1.pdf", "2.pdf", "9.txt"), _names(spark, "1.html", "3.html")
    assert rows(fetch_plan(articles, pdfs, htmls), "pmid", "action") == [
        (1, "update"), (1, "update"), (2, "convert"), (3, "pmc"), (4, "doi"), (5, "none"),
    ]
    updated = update_fulltext(articles, pdfs, "http://f", "s3://h")
    got = {r.pmid: (r.pdf[:6], r.html) for r in updated.collect()}
    assert updated.count() == 6
    assert got[1] == ("<embed", "s3://h/1.html") and got[5] == ("old", "s3://h/5.html")


def test_pending_conversions(spark):
    pdfs, htmls = _names(spark, "a.pdf", "b.pdf", "c.txt"), _names(spark, "a.html", "c.html")
    assert rows(pending_conversions(pdfs, htmls)) == [("b.pdf",)]
    left = pdfs.withColumn("project", F.lit("p"))
    other = htmls.withColumn("project", F.lit("q"))
    assert rows(pending_conversions(left, other, by=["project"]), "name") == [("a.pdf",), ("b.pdf",)]


def test_fulltext_run(spark, tmp_path):
    for name in ("pdf/1.pdf", "html/1.html", "pdf/2.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    articles = spark.createDataFrame(
        [(1, "", "", "", ""), (2, "", "", "", ""), (3, "", "d", "", "")],
        "pmid bigint, pmcid string, doi string, pdf string, html string",
    )
    run = fulltext_run(spark, articles, f"{tmp_path}/pdf", f"{tmp_path}/html", "http://f", "s3://h")
    assert rows(run.plan, "pmid", "action") == [(1, "update"), (2, "convert"), (3, "doi")]
    assert [r[0] for r in rows(run.updated.where("pdf <> ''"), "pmid")] == [1, 2]


def test_run_summary(spark):
    hits = spark.createDataFrame([("f", 1), ("f", 2), ("f", 2), ("g", 3)], "filename string, pmid int")
    kept = hits.where("pmid = 2")
    runs = spark.createDataFrame([("f", "q"), ("g", "r"), ("none", "s")], "filename string, query_str string")
    assert rows(run_summary(hits, kept, runs, F.lit("now"))) == [
        ("now", "q", 3, 1, 2, "f"),
        ("now", "r", 1, 1, 0, "g"),
    ]


def test_page_plan(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 250), ("c", 251), ("d", 6_000_000)], "q string, n bigint")
    got = page_plan(counts)
    assert rows(got.where("q <> 'd'"), "q", "page", "offset") == [
        ("a", 0, 0), ("b", 0, 0), ("b", 1, 250), ("c", 0, 0), ("c", 1, 250),
    ]
    big = got.where("q = 'd'").agg(F.count("*"), F.countDistinct("page"), F.max("offset")).first()
    assert tuple(big) == (24_001, 24_001, 6_000_000)


def test_limit_results_cuts_before_the_shuffle(spark):
    results = spark.range(100).select(
        (F.col("id") % 2).alias("query"), (F.col("id") / 10).cast("int").alias("page"), (F.col("id") % 10).alias("pos")
    )
    got = limit_results(results, 12)
    assert rows(got) == [(q, i // 10, i % 10) for q in (0, 1) for i in range(q, 24, 2)]
    assert "WindowGroupLimit" in plan_text(got) and "Partial" in plan_text(got)


def test_metadata_run_writes_everything(spark, raw, tmp_path):
    incoming = spark.createDataFrame([("1",), ("2",), ("3",), ("5",), ("1",)], "pmid string")
    earlier = spark.createDataFrame([("old.json", 2, "seen")], "file_name string, pmid bigint, title string")
    run = metadata_run(incoming, raw, earlier, "2024-01-01", "new.json", "q", "Me")
    out = f"{tmp_path}/metadata/new.json"
    write_metadata_run(run, out, f"{tmp_path}/history")
    assert rows(spark.read.parquet(out), "pmid", "tag") == [(1, "Me"), (1, "Me"), (3, "Me")]
    assert rows(spark.read.parquet(duplicates_path(out)), "pmid", "title") == [(2, "seen")]
    assert rows(spark.read.parquet(f"{tmp_path}/history")) == [("2024-01-01", "q", 5, 1, 4, "new.json")]
    assert rows(run.rejects, "pmid") == [("5",)]
    with pytest.raises(Exception, match="already exists"):
        write_metadata_run(run, out, f"{tmp_path}/history")


@pytest.mark.parametrize("broken", ["articles", "duplicates", "history", "manifest", None])
def test_a_broken_run_leaves_nothing_and_is_repeated(spark, raw, tmp_path, monkeypatch, broken):
    base, incoming = f"{tmp_path}/runs", spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    earlier = spark.createDataFrame([], f"file_name string, {ARTICLE.toDDL()}")
    one = metadata_run(incoming, raw, earlier, "2024-01-01", "one.json", "q", "Me")
    assert commit_metadata_run(one, base, "p/metadata/one.json", "r1")
    first = rows(read_committed_articles(spark, base), "file_name", "pmid")
    run = metadata_run(incoming, raw, read_committed_articles(spark, base), "2024-01-02", "two.json", "q", "Me")

    # The writer stops behind (for None: before) the output that is named.
    written = DataFrameWriter.parquet, DataFrameWriter.json

    def stopping(write, last):
        def put(self, path, *args, **kwargs):
            if broken is None:
                raise OSError("stopped")
            write(self, path, *args, **kwargs)
            if f"/{broken}/" in path:
                raise OSError("stopped")

        return put

    monkeypatch.setattr(DataFrameWriter, "parquet", stopping(written[0], broken))
    monkeypatch.setattr(DataFrameWriter, "json", stopping(written[1], broken))
    with pytest.raises(OSError, match="stopped"):
        commit_metadata_run(run, base, "p/metadata/two.json", "r2")
    monkeypatch.undo()
    if broken != "manifest":
        assert rows(read_committed_articles(spark, base), "file_name", "pmid") == first
        assert rows(read_history(spark, base), "filename") == [("one.json",)]
    assert commit_metadata_run(run, base, "p/metadata/two.json", "r2") == (broken != "manifest")
    assert not commit_metadata_run(run, base, "p/metadata/two.json", "r2")
    got = rows(read_committed_articles(spark, base), "file_name", "pmid")
    assert got == sorted([*first, *[("two_duplicated", r[1]) for r in first]])
    assert rows(read_history(spark, base), "filename", "duplicated_articles") == [("one.json", 0), ("two.json", 3)]
    with pytest.raises(FileExistsError, match="already exists"):
        commit_metadata_run(run, base, "p/metadata/two.json", "r3")
    with pytest.raises(ValueError, match="folder"):
        commit_metadata_run(run, base, "p/metadata/x.json", "a/b")


def test_runs_that_are_not_there(spark, tmp_path):
    assert read_committed_articles(spark, f"{tmp_path}/none").isEmpty()
    assert read_history(spark, f"{tmp_path}/none").isEmpty()
