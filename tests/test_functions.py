import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import paths as p
from citeloom.functions.accounts import policy_document
from citeloom.functions.bib import bib_field
from citeloom.functions.fulltext import html_object, pdf_markup
from citeloom.functions.status import MESSAGES, status_message
from citeloom.functions.text import (
    classify_identifier,
    member_key,
    normalize_query,
    pmid_from_url,
    slug,
)
from tests.helpers import values


def test_normalize_query(spark):
    assert values(spark, ["'a b' OR c", ""], normalize_query) == ['"a b" OR c', ""]


def test_classify_identifier(spark):
    cases = {
        "http://a/b.pdf": "url-direct",
        "https://a/bpdf": "url-direct",
        "httpfoo": "url-non-direct",
        "https://a/b": "url-non-direct",
        "123": "pmid",
        "١٢٣": "pmid",
        "12²": "doi",
        "12\n": "doi",
        "": "doi",
        "10.1/x.pdf": "doi",
    }
    assert values(spark, list(cases), classify_identifier) == list(cases.values())


def test_pmid_from_url(spark):
    urls = ["https://pubmed.gov/12", "https://pubmed.gov/12/", "https://x.org/12", "pubmed"]
    assert values(spark, urls, pmid_from_url) == ["12", "", None, "pubmed"]


def _slug_by_hand(title):
    dashed = "".join(c if c.isalnum() else "-" for c in title).lower()
    return "-".join(part for part in dashed.split("-") if part)


def test_slug_matches_character_walk(spark):
    pick = random.Random(5)
    letters = "aZ9 -_.,éÜßñЖя中文ª½Ⅷ\t/\\'\"&"
    titles = ["".join(pick.choices(letters, k=pick.randint(0, 15))) for _ in range(300)]
    assert values(spark, titles, slug) == [_slug_by_hand(x) for x in titles]


def test_member_key(spark):
    row = spark.range(1).select(member_key(F.lit("a@x"), F.lit(7)).alias("k")).first()
    assert row.k == hashlib.md5(b"a@x:7").hexdigest()


def test_policy_document(spark):
    text = values(spark, ["lab"], policy_document)[0]
    assert json.loads(text) == {
        "Version": "2012-10-17",
        "Statement": [
            {"Effect": "Allow", "Action": ["s3:*"], "Resource": ["arn:aws:s3:::lab/*"]}
        ],
    }


@pytest.mark.parametrize("root", ["/data", "/data/"])
def test_project_name_and_dirs(spark, root):
    paths = ["/data/p1/pdf/a.pdf", "/data//p2/x", "/data/"]
    assert values(spark, paths, lambda c: p.project_name(root, c)) == ["p1", "p2", None]
    got = values(spark, paths[:1], lambda c: p.project_dirs(root, c))[0]
    assert got.asDict() == {d: f"/data/p1/{d}" for d in ("config", "metadata", "html", "pdf")}


def test_derived_paths(spark):
    path = "/data/myconfig/config/q.yaml"
    one = lambda f: values(spark, [path], f)[0]
    assert one(p.config_log_path) == "/data/mylog/log/q.log"
    assert one(lambda c: p.destination_path("/data", c)) == "/data/myconfig/metadata/q.json"
    names = ["/data/p/config/a.yml", "/data/p/config/ayaml", "/data/p/config/b.bib", "/data/p/config/c.json"]
    assert values(spark, names, lambda c: p.destination_path("/data", c)) == [
        None,
        "/data/p/metadata/ayaml",
        "/data/p/metadata/b.json",
        "/data/p/metadata/c.json",
    ]
    assert values(spark, ["/r/pdfs/pdf/a.pdf"], p.html_path) == ["/r/htmls/html/a.html"]
    assert values(spark, ["a.pdf.pdf"], p.html_name) == ["a.html.html"]
    assert values(spark, ["/data/p/pdf/a.pdf"], lambda c: p.pdf_log_path("/data", c)) == [
        "/data/p/log/a.log"
    ]


def test_config_format(spark):
    names = ["a.json", "a.yaml", "ayaml", "a.bib", "xbib", "a.yml", "json"]
    assert values(spark, names, p.config_format) == [
        "json", "yaml", "yaml", "bib", "bib", "invalid", "invalid",
    ]


def test_watch_filter(spark):
    names = ["/r/a.json", "/r/a.PDF", "/r/a.json.tmp", "/r/.gitkeep", "/r/.minio.sys/a.json", "/r/a.txt"]
    assert values(spark, names, p.is_watched) == [True, True, True, False, False, False]
    assert values(spark, names, lambda c: p.is_watched(c, strict=True))[2] is False


def test_route_path(spark):
    cases = {
        "/r/p/pdf/a.pdf": ("pdf", "pdf"),
        "/r/p/pdf_old/a.pdf": ("pdf", "ignored"),
        "/r/p/pdf/a.txt": ("ignored", "ignored"),
        "/r/p/config/a.json": ("config", "config"),
        "/r/p/configs/a.json": ("config", "ignored"),
        "/r/.p/pdf/a.pdf": ("ignored", "ignored"),
        "/r/p/pdf/.a.pdf": ("ignored", "ignored"),
        "/r/p/html/a.html": ("ignored", "ignored"),
        "/r": ("ignored", "ignored"),
    }
    loose = values(spark, list(cases), lambda c: p.route_path("/r", c))
    strict = values(spark, list(cases), lambda c: p.route_path("/r", c, strict=True))
    assert list(zip(loose, strict, strict=True)) == list(cases.values())


def test_document_name(spark):
    urls = ["https://x.org/a/paper.pdf#view=FitH", "https://x.org/" + "y" * 30, "https://x.org/"]
    got = values(spark, urls, lambda c: p.document_name(c, F.lit("body")))
    digest = hashlib.md5(b"body").hexdigest()
    assert got == [f"{digest}-paper.pdf", f"{digest}-{'y' * 20}", f"{digest}-"]


def test_fulltext_markup(spark):
    row = spark.range(1).select(
        pdf_markup(F.lit(5), "https://f/pdf/").alias("pdf"), html_object(F.lit(5), "s3://b/html").alias("html")
    ).first()
    assert row.pdf == "<embed src='https://f/pdf/5.pdf' width='100%' height='600px' type='application/pdf'>"
    assert row.html == "s3://b/html/5.html"


def test_status_messages(spark):
    stages = [*MESSAGES, "unknown"]
    got = values(spark, stages, lambda c: status_message(c, F.lit("lab"), F.lit("boom"), {"studio": "S"}))
    assert got[-1] is None
    assert all("lab" in m and "{" not in m for m in got[:-1])
    by_stage = dict(zip(stages, got, strict=True))
    assert by_stage["failed"].endswith("\nboom") and "前往S查看" in by_stage["pdf_converted"]


def test_bib_fields(spark):
    entries = {
        "article{k, pmid = {12}, url={u}}": "12",
        'article{k,\n PMID="13" }': "13",
        "article{k, pmid = 14}": "14",
        "article{k, pmid = { 15 }}": "15",
        "article{k, pmid = {}}": None,
        "article{k, xpmid = {1}}": None,
        "article{pmid, title={pmid = 3}}": None,
    }
    assert values(spark, list(entries), lambda c: bib_field(c, "pmid")) == list(entries.values())
