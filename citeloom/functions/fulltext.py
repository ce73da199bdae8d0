"""Expressions for the full-text columns of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pdf_markup(pmid: Column, pdf_base: str) -> Column:
    """Embed tag that shows the article's PDF."""
    url = F.concat(F.lit(pdf_base.rstrip("/") + "/"), pmid.cast("string"), F.lit(".pdf"))
    # Fixed value: the tag's attributes.
    return F.format_string(
        "<embed src='%s' width='100%%' height='600px' type='application/pdf'>", url
    )


def html_object(pmid: Column, html_base: str) -> Column:
    """Object path of the article's HTML, set whether or not it exists yet."""
    return F.concat(F.lit(html_base.rstrip("/") + "/"), pmid.cast("string"), F.lit(".html"))
