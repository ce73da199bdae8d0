"""Snapshots of storage users, organizations, memberships and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.schemas import GROUP_INFO, MEMBERSHIP_PAGE, ORGANIZATION, REGISTERED_USER


def read_registered_users(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines and empty files give no rows."""
    return spark.read.schema(REGISTERED_USER).json(path)


def read_organizations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORGANIZATION).option("multiLine", True).json(path)


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """Users of all membership pages, with the organization they belong to."""
    pages = spark.read.schema(MEMBERSHIP_PAGE).option("multiLine", True).json(path)
    return pages.select(F.inline("results")).select("organization", "user.*")


def read_group_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of each group; a group without any gives no rows."""
    groups = spark.read.schema(GROUP_INFO).option("multiLine", True).json(path)
    return groups.select(F.col("groupName").alias("bucket"), F.explode("members").alias("email"))
