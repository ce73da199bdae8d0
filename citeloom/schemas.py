"""Row shapes of the inputs and outputs, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}


def _flat(text: str) -> T.StructType:
    """Struct of plain fields; works before a session exists, unlike DDL text."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The fixed article record: seventeen flat fields, "" marks a missing text.
ARTICLE = _flat(
    "tag string, pmid bigint, pmcid string, pmc_link string, pubmed_link string, "
    "abstract string, title string, imported_date string, authors string, "
    "journal_abbr string, journal string, pdf string, html string, "
    "impact_factor double, publication string, doi string, doi_link string"
)

# The same record as found in files: ids come as numbers or as text.
ARTICLE_IN_FILE = T.StructType(
    [T.StructField(f.name, T.StringType()) if f.name == "pmid" else f for f in ARTICLE.fields]
)

RAW_ARTICLE = (
    "pmid string, pmc string, abstract string, title string, authors array<string>, "
    "journal string, year string, doi string"
)

QUERY_CONFIG = _flat("query_str string, author string, download_pdf boolean")

HISTORY = _flat(
    "time string, query_str string, total_articles bigint, duplicated_articles bigint, "
    "valid_articles bigint, filename string"
)

# Nested shapes stay DDL text, which every reader takes as it is.
BUCKET_EVENT = (
    "Records array<struct<eventName: string, s3: struct<bucket: struct<name: string>, "
    "object: struct<key: string>>>>"
)

REGISTERED_USER = _flat(
    "status string, accessKey string, policyName string, userStatus string"
)

ORGANIZATION = _flat("id bigint, title string, created_by bigint")

MEMBERSHIP_PAGE = (
    "count bigint, next string, previous string, "
    "results array<struct<id: bigint, organization: bigint, user: struct<"
    "id: bigint, first_name: string, last_name: string, username: string, email: string, "
    "last_activity: string, avatar: string, initials: string, phone: string, "
    "active_organization: bigint, allow_newsletters: boolean, is_superuser: boolean, "
    "created_projects: string, contributed_to_projects: string>>>"
)

GROUP_INFO = (
    "status string, groupName string, members array<string>, groupStatus string"
)

BINARY_FILE = _flat(
    "path string, modificationTime timestamp, length bigint, content binary"
)
