"""Expressions over queries, identifiers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_query(query: Column) -> Column:
    """Search services want double quotes round a phrase."""
    return F.replace(query, F.lit("'"), F.lit('"'))


def classify_identifier(identifier: Column) -> Column:
    """``url-direct``, ``url-non-direct``, ``pmid`` or ``doi``.

    Only decimal digits count as an id; superscripts and the like do not.
    """
    return (
        F.when(
            F.startswith(identifier, F.lit("http")),
            F.when(F.endswith(identifier, F.lit("pdf")), "url-direct").otherwise("url-non-direct"),
        )
        .when(identifier.rlike(r"\A\p{Nd}+\z"), "pmid")
        .when(identifier.isNotNull(), "doi")
    )


def pmid_from_url(url: Column) -> Column:
    """Last segment of an address that mentions ``pubmed``, else null.

    A trailing slash gives the empty string.
    """
    return F.when(F.contains(url, F.lit("pubmed")), F.substring_index(url, "/", -1))


def slug(title: Column) -> Column:
    """Lower-case title with every run of other characters as one dash."""
    dashed = F.regexp_replace(title, r"[^\p{L}\p{N}]+", "-")
    return F.btrim(F.lower(dashed), F.lit("-"))


def member_key(email: Column, user_id: Column) -> Column:
    """Stable surrogate key of a member. It is guessable, so never a password."""
    return F.md5(F.concat(email, F.lit(":"), user_id.cast("string")))


def is_valid_pmid(pmid: Column, numeric: bool = False) -> Column:
    """True for ids that are neither null, empty nor zero."""
    if numeric:
        return pmid.isNotNull() & (pmid != 0)
    return pmid.isNotNull() & ~pmid.cast("string").isin("", "0")
