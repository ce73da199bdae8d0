"""Account plan from a folder of snapshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators.access import access_plan
from citeloom.sources.accounts import (
    read_memberships,
    read_organizations,
    read_registered_users,
)


def snapshot_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Plan from ``organizations``, ``memberships`` and ``users`` below a folder."""
    return access_plan(
        read_organizations(spark, f"{folder}/organizations"),
        read_memberships(spark, f"{folder}/memberships"),
        read_registered_users(spark, f"{folder}/users"),
    )
