"""Link and result extraction from HTML pages, by pattern.

Comments, scripts and style sheets are taken out first. Attribute values may
stand in double quotes, single quotes or none. Broken markup can come out
differently than from a DOM parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is not closed goes on to the end of the page, so it is passed over once.
_HIDDEN = r"(?is)<(?:!--(?:.*?-->|.*\z)|(script|style)\b(?:.*?</\1\s*>|.*\z))"
# One attribute: its name and, after an equals sign, its value. Matches follow each
# other, so a quoted value is never taken for attributes.
_ATTRIBUTE = r"""\s([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""
_ANY_TAG = r"<[^>]*>"


def _open_tag(name: str) -> str:
    """Start tag whose attribute values may hold a closing bracket."""
    return rf"""(?is)<{name}\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""


def _class_tag(name: str, token: str) -> str:
    """Start of a tag that carries a class token (checked again afterwards)."""
    return rf"""(?is)<{name}\b[^<>]*?\sclass\s*=\s*["']?(?:[^"'<>]*\s)?{token}(?=[\s"'>])"""


def visible(html: Column) -> Column:
    return F.regexp_replace(html, _HIDDEN, "")


def decode_entities(text: Column) -> Column:
    """The five named entities of markup, and the two numeric quotes."""
    for entity, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#34;", '"'),
        ("&apos;", "'"),
        ("&#39;", "'"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once where an expression needs it repeatedly."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _group(text: Column, pattern: str) -> Column:
    """First group of the first match; null, unlike ``regexp_extract``, if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1))


def _attributes(tag: Column) -> Column:
    """Names in lower case and raw values of a start tag's attributes, in order."""
    return F.struct(
        F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("values"),
    )


def _value(attributes: Column, name: str) -> Column:
    """Value of the first attribute of a name; null when it is not there.

    A name without a value has an empty one here; an empty value still has its quotes.
    """
    place = F.array_position(attributes["names"], name)
    raw = F.when(place > 0, F.try_element_at(attributes["values"], place.cast("int")))
    return _let(raw, lambda r: F.when(r != "", decode_entities(F.regexp_replace(r, r"""(?s)\A(["'])(.*)\1\z""", "$2"))))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag; null when it is not there."""
    return _let(_attributes(tag), lambda a: _value(a, name))


def _has_class(attributes: Column, token: str) -> Column:
    return F.array_contains(F.split(F.coalesce(_value(attributes, "class"), F.lit("")), r"\s+"), token)


def _tags(html: Column) -> Column:
    """The text up to its last closing bracket, as there is no tag beyond it."""
    return F.regexp_extract(html, r"(?s)\A.*>", 0)


def start_tags(html: Column, *names: str) -> Column:
    """The page's start tags of these names, in order: ``place, name, attributes``.

    ``attributes`` holds ``names`` and raw ``values``. The page is read once; keep
    the column (or bind it in a ``transform``) and take all links from it.
    """
    any_name = "(?:" + "|".join(names) + ")"
    found = F.regexp_extract_all(_tags(visible(html)), F.lit(_open_tag(any_name)), F.lit(0))

    def token(tag: Column, place: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"\A<([^\s/>]+)", 1))
        return F.struct(place.alias("place"), name.alias("name"), _attributes(tag).alias("attributes"))

    return F.transform(found, token)


def _first_tag(html: Column, name: str) -> Column:
    """Attributes of the first start tag of a name; null if there is none."""
    tag = F.regexp_extract(_tags(html), _open_tag(name), 0)
    return _let(tag, lambda t: F.when(t != "", _attributes(t)))


def resolve_iframe(html: Column) -> Column:
    """Source of the first inline frame, ``//`` completed with ``http:``."""

    def source(page: Column) -> Column:
        src = _let(_first_tag(visible(page), "iframe"), lambda a: _value(a, "src"))
        return F.when(page.rlike("(?i)<iframe"), F.regexp_replace(src, r"\A//", "http://"))

    return _let(html, source)


def distinct_links(html: Column, css_class: str) -> Column:
    """Different targets of the anchors that carry a class."""

    def targets(page: Column) -> Column:
        hits = F.filter(start_tags(page, "a"), lambda t: _has_class(t["attributes"], css_class))
        links = F.transform(hits, lambda t: _value(t["attributes"], "href"))
        return F.when(F.contains(page, F.lit(css_class)), F.array_distinct(F.array_compact(links))).otherwise(
            F.array().cast("array<string>")
        )

    return _let(html, targets)


# The site and class of PDF links, the classes of search results, the word
# that tells a captcha page, and the message about one.
PDF_SITE, PDF_CLASS = "https://www.ncbi.nlm.nih.gov", "int-view"
RESULT_CLASS, TITLE_CLASS, PDF_BLOCK_CLASS = "gs_r", "gs_rt", "gs_ggs gs_fl"
CAPTCHA_WORD = "CAPTCHA"
CAPTCHA_MESSAGE = "Failed to complete search with query %s (captcha)"


def extract_pdf_link(
    html: Column, base: str = PDF_SITE, css_class: str = PDF_CLASS
) -> Column:
    """Full address of the page's PDF link; the smallest one if there are several."""
    return F.concat(F.lit(base), F.array_min(distinct_links(html, css_class)))


def _division(html: Column) -> Column:
    """The text's leading ``<div>`` up to its own end tag.

    The text is cut before every division tag; the running depth tells which
    pieces belong to the leading division.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("kept"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        change = (
            F.when(piece.rlike(r"(?i)\A</div\b"), -1).when(piece.rlike(r"(?i)\A<div\b"), 1)
        ).otherwise(0)
        depth = acc["depth"] + change
        done = acc["done"] | (depth <= 0)
        return F.struct(
            depth.alias("depth"),
            F.when(done, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
            done.alias("done"),
        )

    def leading(pieces: Column) -> Column:
        kept = F.aggregate(pieces, start, step, lambda acc: acc["kept"])
        return F.array_join(F.slice(pieces, 1, kept), "")

    return _let(F.split(html, r"(?i)(?=</?div\b)"), leading)


_RESULT = r"array<struct<name:string,url:string>>"


def search_results(html: Column) -> Column:
    """Name and address of each result on a search page, in page order.

    A result is a division with class ``gs_r`` that holds no table. Its address
    is the link in the PDF block, else the link in the title; results without
    either, or without a title, are left out.
    """
    cuts = F.split(visible(html), "(?is)(?=" + _class_tag("div", RESULT_CLASS) + ")")

    def begins(block: Column) -> Column:
        tag = F.regexp_extract(block, _open_tag("div").replace("<div", r"\A<div", 1), 0)
        return _let(tag, lambda t: F.when(t != "", _let(_attributes(t), lambda a: _has_class(a, RESULT_CLASS))))

    blocks = F.filter(cuts, begins)
    whole = F.filter(F.transform(blocks, _division), lambda b: ~b.rlike(r"(?i)<table\b"))

    def parts(block: Column) -> Column:
        title = _class_tag("h3", TITLE_CLASS) + r"[^>]*>(.*?)</h3\s*>"
        exact = rf"""(?is)<div\b[^<>]*?\sclass\s*=\s*(?:"{PDF_BLOCK_CLASS}"|'{PDF_BLOCK_CLASS}').*\z"""
        return F.struct(
            _group(block, title).alias("title"),
            _division(F.regexp_extract(block, exact, 0)).alias("pdf"),
        )

    def result(part: Column) -> Column:
        holder = F.when(part["pdf"] != "", part["pdf"]).otherwise(part["title"])
        return F.struct(
            decode_entities(F.regexp_replace(part["title"], _ANY_TAG, "")).alias("name"),
            _let(_first_tag(holder, "a"), lambda a: _value(a, "href")).alias("url"),
        )

    found = F.transform(F.transform(whole, parts), result)
    kept = F.filter(found, lambda r: r["name"].isNotNull() & r["url"].isNotNull())
    return F.when(F.contains(html, F.lit(RESULT_CLASS)), kept.cast(_RESULT)).otherwise(
        F.array().cast(_RESULT)
    )


def search_error(html: Column, query: Column) -> Column:
    """Message when the page asks for a captcha instead of showing results."""
    message = F.format_string(CAPTCHA_MESSAGE, query)
    empty = ~visible(html).rlike(_class_tag("div", RESULT_CLASS))
    return F.when(F.contains(html, F.lit(CAPTCHA_WORD)) & empty, message)


def extract_search_results(html: Column, query: Column) -> Column:
    """Struct of ``papers`` and ``err`` for one search page."""
    return F.struct(
        search_results(html).alias("papers"), search_error(html, query).alias("err")
    )


def embed_style(html: Column, css: Column | str) -> Column:
    """Put a style sheet at the end of the head, or into a new head in front."""
    sheet = F.lit(css) if isinstance(css, str) else css
    style = F.concat(F.lit("<style>"), sheet, F.lit("</style>"))

    def put(end: Column) -> Column:
        return F.when(
            end > 0,
            F.concat(F.substr(html, F.lit(1), end - 1), style, F.substr(html, end)),
        ).otherwise(F.concat(F.lit("<head>"), style, F.lit("</head>"), html))

    return _let(F.regexp_instr(html, F.lit(r"(?i)</head\s*>")), put)
