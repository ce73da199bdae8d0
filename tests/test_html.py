import time

import pytest
from pyspark.sql import functions as F

from citeloom.functions.html import (
    attribute,
    distinct_links,
    embed_style,
    extract_pdf_link,
    extract_search_results,
    resolve_iframe,
    search_results,
    start_tags,
)
from tests.helpers import values


def test_attribute_forms(spark):
    tags = {
        '<a href="x">': "x",
        "<a href='x y'>": "x y",
        "<a href=x/y>": "x/y",
        '<a HREF = "a&amp;b">': "a&b",
        '<a data-href="no">': None,
        '<a title=" href=no" href="yes">': "yes",
        '<a href="">': "",
        "<a>": None,
    }
    assert values(spark, list(tags), lambda c: attribute(c, "href")) == list(tags.values())


def test_resolve_iframe(spark):
    pages = {
        '<p><iframe src="//h/a.pdf"></iframe>': "http://h/a.pdf",
        "<IFRAME width=3 SRC='https://h/b'>": "https://h/b",
        "<iframe title='a > b' src=/c>": "/c",
        "<!-- <iframe src='no'> --><script>'<iframe src=no>'</script>": None,
        "<iframe></iframe><iframe src='second'>": None,
        "no frame": None,
    }
    assert values(spark, list(pages), resolve_iframe) == list(pages.values())


def test_pdf_links(spark):
    page = (
        "<a class='int-view' href='/b'>1</a><a href=/a class='x int-view y'>2</a>"
        "<a class='int-viewer' href='/0'>3</a><a class=int-view>4</a><a class='int-view' href='/b'>5</a>"
        "<!-- <a class='int-view' href='/00'> -->"
    )
    assert values(spark, [page], lambda c: distinct_links(c, "int-view"))[0] == ["/b", "/a"]
    got = values(spark, [page, "<p>int-view</p>", "none"], lambda c: extract_pdf_link(c, "http://h"))
    assert got == ["http://h/a", None, None]


def _search(spark, page):
    found = values(spark, [page], lambda c: extract_search_results(c, F.lit("q")))[0]
    return [(r["name"], r["url"]) for r in found["papers"]], found["err"]


def test_search_results(spark):
    page = """<html><div class="gs_r gs_or gs_scl"><div class="gs_ggs gs_fl"><div><a href="u1.pdf">[PDF]</a></div></div>
      <div><h3 class='gs_rt'><span>[B]</span> <a href="u1">One <b>bold</b> &lt;x&gt;</a></h3></div></div>
      <div class=gs_r><h3 class="x gs_rt"><a id=i href=u2>Two</a></h3><div class="gs_ggs gs_fl other"><a href="no">x</a></div></div>
      <div class="gs_r"><table></table><h3 class="gs_rt"><a href="u3">Three</a></h3></div>
      <div class="gs_r"><h3 class="gs_rt">Four</h3></div>
      <div class="gs_r"><div class="gs_ggs gs_fl"><a href="u5">no title</a></div></div>
      <div class="gs_rx"><h3 class="gs_rt"><a href="u6">Six</a></h3></div>
      <div class="gs_r"><h3 class="gs_rt"><a href="u7">Seven</a></h3></div><div><table></table></div></html>"""
    papers, err = _search(spark, page)
    assert papers == [("[B] One bold <x>", "u1.pdf"), ("Two", "u2"), ("Seven", "u7")]
    assert err is None


def test_search_error(spark):
    assert _search(spark, "<p>CAPTCHA</p>") == (
        [],
        "Failed to complete search with query q (captcha)",
    )
    assert _search(spark, "<p>nothing</p>") == ([], None)
    assert _search(spark, '<div class="gs_r">CAPTCHA</div>') == ([], None)


def test_embed_style(spark):
    pages = ["<html><HEAD><t/></HEAD><body></head></body>", "<p>x</p>"]
    assert values(spark, pages, lambda c: embed_style(c, "a { b: $1 \\ }")) == [
        "<html><HEAD><t/><style>a { b: $1 \\ }</style></HEAD><body></head></body>",
        "<head><style>a { b: $1 \\ }</style></head><p>x</p>",
    ]


@pytest.mark.parametrize(
    "page",
    [
        "<!--" * 250_000,
        '<a ' + 'x="1" ' * 100_000 + 'class="int-view" href="/u">y</a>',
        "<div>" * 100_000 + "gs_r",
        '<div class="gs_r">' * 3_000,
        '<a b="' * 100_000 + "gs_r int-view",
    ],
    ids=["comments", "attributes", "divisions", "results", "quotes"],
)
def test_broken_pages_take_linear_time(spark, page):
    for use in (resolve_iframe, lambda h: distinct_links(h, "int-view"), search_results):
        values(spark, ["x"], use)  # compiled before the clock starts
        start = time.monotonic()
        values(spark, [page], use)
        assert time.monotonic() - start < 5


def test_start_tags_are_one_column(spark):
    page = "<p><A href='/1' class=x>a</A><!-- <a href=no> --><iframe SRC=\"//f\"></iframe><abbr><a\nhref=/2>"
    got = values(spark, [page, "", "no tag"], lambda c: start_tags(c, "a", "iframe"))
    assert [(t["place"], t["name"], t["attributes"]["names"]) for t in got[0]] == [
        (0, "a", ["href", "class"]), (1, "iframe", ["src"]), (2, "a", ["href"]),
    ]
    assert got[1:] == [[], []]


def test_page_is_read_once(spark):
    """The costly step, taking out comments and scripts, stands once in each expression."""
    pages = spark.createDataFrame([("<p>",)], "html string")
    for found in (resolve_iframe(F.col("html")), distinct_links(F.col("html"), "x"), search_results(F.col("html"))):
        plan = pages.select(found.alias("x"))._jdf.queryExecution().analyzed()
        assert plan.expressions().head().sql().count("!--") == 1


def test_broken_pages_take_linear_time(spark):
    def seconds(size):
        pages = ["<!-- a" * size, "<a href=" * size, "<iframe " * size, "<script>" * size, "<a class='x" * size]
        frame = spark.createDataFrame([(p,) for p in pages], "html string").coalesce(1).cache()
        frame.count()
        start = time.perf_counter()
        frame.select(resolve_iframe(F.col("html")), distinct_links(F.col("html"), "x")).collect()
        return time.perf_counter() - start

    seconds(1000)
    # About 1.2 MB a page against 0.3 MB.
    assert seconds(160_000) < 10 * max(seconds(40_000), 0.2)
