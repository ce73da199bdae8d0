"""Queries over organizations, memberships and storage accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.bindings import tables as t
from citeloom.functions.accounts import policy_document
from citeloom.functions.text import member_key
from citeloom.operators.access import (
    access_plan,
    bucket_layout,
    group_drift,
    group_member_parts,
    group_members,
    organization_members,
    regular_members,
    split_members,
    with_bucket,
)
from citeloom.plans.access import snapshot_plan
from citeloom.sources.accounts import (
    read_group_members,
    read_memberships,
    read_organizations,
    read_registered_users,
)
from citeloom.sources.articles import write_articles
from citeloom.storage import shared_dir
from citeloom.streaming import jobs


def _members(spark: SparkSession, sf: str) -> DataFrame:
    users = regular_members(t.memberships(spark, sf))
    return split_members(
        organization_members(t.organizations(spark, sf), users), t.registered_users(spark, sf)
    )


def q_bucket_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets of customers, whose names stand for project titles."""
    orgs = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return bucket_layout(orgs)


_LAYOUT = r"""SELECT bucket, directory, bucket || '/' || directory || '/.gitkeep' AS object
FROM (SELECT *, unnest(['log', 'config', 'pdf', 'html', 'metadata']) AS directory
      FROM (SELECT DISTINCT trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS bucket
            FROM customer))"""


def q_policy_document(spark: SparkSession, sf: str) -> DataFrame:
    orgs = t.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title"))
    return with_bucket(orgs).select("c_custkey", policy_document(F.col("bucket")).alias("policy"))


_POLICY_TEXT = (
    """'{"Version":"2012-10-17","Statement":[{"Effect":"Allow","Action":["s3:*"],"""
    """"Resource":["arn:aws:s3:::' || bucket || '/*"]}]}'"""
)

_POLICY = rf"""SELECT c_custkey, {_POLICY_TEXT} AS policy
FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-') AS bucket
      FROM customer)"""


def q_member_key(spark: SparkSession, sf: str) -> DataFrame:
    key = member_key(F.col("email"), F.col("id"))
    return t.memberships(spark, sf).select("id", key.alias("member_key"))


_KEY = f"WITH {t.ACCOUNTS} SELECT id, md5(email || ':' || id) AS member_key FROM memberships"


def _flag_as_text(users: DataFrame) -> DataFrame:
    """The flag may be null, which a column of truth values cannot always show."""
    return users.withColumn("is_superuser", F.col("is_superuser").cast("string"))


def q_regular_members(spark: SparkSession, sf: str) -> DataFrame:
    return _flag_as_text(regular_members(t.memberships(spark, sf)))


_REGULAR = f"""WITH {t.ACCOUNTS}
SELECT * REPLACE (CAST(is_superuser AS VARCHAR) AS is_superuser)
FROM memberships WHERE is_superuser IS NOT TRUE"""


def q_organization_members(spark: SparkSession, sf: str) -> DataFrame:
    return _flag_as_text(organization_members(t.organizations(spark, sf), t.memberships(spark, sf)))


_ORG_MEMBERS = f"""WITH {t.ACCOUNTS}
SELECT m.* REPLACE (CAST(is_superuser AS VARCHAR) AS is_superuser), o.bucket FROM memberships m JOIN orgs o ON o.id = m.organization"""


def q_split_members(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).select("organization", "bucket", "id", "email", "is_registered")


_SPLIT = f"WITH {t.ACCOUNTS} SELECT * FROM members"


def _as_text(groups: DataFrame) -> DataFrame:
    return groups.select("bucket", "part", F.array_join("members", ",").alias("members"))


def q_group_members(spark: SparkSession, sf: str) -> DataFrame:
    return group_members(_members(spark, sf))


def q_group_members_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _as_text(group_member_parts(_members(spark, sf), batch=20))


def _groups_sql(batch: int) -> str:
    return f"""WITH {t.ACCOUNTS},
emails AS (SELECT DISTINCT bucket, email FROM members),
sizes AS (SELECT bucket, CAST(ceil(count(*) / {batch}) AS BIGINT) AS parts FROM emails GROUP BY bucket)
SELECT bucket, CAST('0x' || substring(md5(email), 1, 8) AS BIGINT) % parts AS part,
       string_agg(email, ',' ORDER BY email) AS members
FROM emails JOIN sizes USING (bucket) GROUP BY ALL"""


def q_access_plan(spark: SparkSession, sf: str) -> DataFrame:
    return access_plan(
        t.organizations(spark, sf), t.memberships(spark, sf), t.registered_users(spark, sf)
    )


_PLAN = f"""WITH {t.ACCOUNTS},
peopled AS (SELECT DISTINCT organization, bucket FROM members)
SELECT id AS organization, bucket, 1 AS step, 'make_bucket' AS action, CAST(NULL AS VARCHAR) AS email,
       CAST(NULL AS VARCHAR) AS member_key, CAST(NULL AS VARCHAR) AS policy FROM orgs
UNION ALL
SELECT organization, bucket, 2, 'register_user', email, md5(email || ':' || id), NULL
FROM members WHERE NOT is_registered
UNION ALL SELECT organization, bucket, 3, 'add_to_group', email, NULL, NULL FROM members
UNION ALL SELECT organization, bucket, 4, 'add_policy', NULL, NULL, {_POLICY_TEXT} FROM peopled
UNION ALL SELECT organization, bucket, 5, 'bind_policy', NULL, NULL, NULL FROM peopled"""


def q_group_drift(spark: SparkSession, sf: str) -> DataFrame:
    held = t.memberships(spark, sf).where("id % 2 = 0")
    actual = organization_members(t.organizations(spark, sf), held)
    return group_drift(_members(spark, sf), actual)


_DRIFT = f"""WITH {t.ACCOUNTS},
actual AS (SELECT o.bucket, m.email FROM memberships m JOIN orgs o ON o.id = m.organization
           WHERE m.id % 2 = 0)
SELECT bucket, email, 'add' AS action FROM (SELECT bucket, email FROM members EXCEPT FROM actual)
UNION ALL
SELECT bucket, email, 'remove' FROM (FROM actual EXCEPT SELECT bucket, email FROM members)"""


def _write_snapshot(spark: SparkSession, sf: str, folder: str) -> None:
    """Snapshot files: organizations, membership pages and line-wise users."""
    orgs = t.organizations(spark, sf).withColumn("created_by", F.lit(1))
    write_articles(orgs, f"{folder}/organizations", "json_array")
    user = F.struct("id", "email", "is_superuser").alias("user")
    pages = (
        t.memberships(spark, sf)
        .select("organization", F.floor(F.col("id") / 100).alias("page"), F.struct("id", "organization", user).alias("r"))
        .groupBy("organization", "page")
        .agg(F.count("*").alias("count"), F.collect_list("r").alias("results"))
        .drop("organization", "page")
    )
    write_articles(pages, f"{folder}/memberships", "json_array")
    t.registered_users(spark, sf).write.json(f"{folder}/users")


def q_read_organizations(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "snapshot")
    _write_snapshot(spark, sf, folder)
    return read_organizations(spark, f"{folder}/organizations")


_ORGS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, CAST(1 AS BIGINT) AS created_by FROM nation"


def q_read_memberships(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "snapshot")
    _write_snapshot(spark, sf, folder)
    users = read_memberships(spark, f"{folder}/memberships")
    return _flag_as_text(users.select("organization", "id", "email", "is_superuser"))


_MEMBERSHIPS = f"WITH {t.ACCOUNTS} SELECT * REPLACE (CAST(is_superuser AS VARCHAR) AS is_superuser) FROM memberships"


def q_read_registered_users(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "snapshot")
    _write_snapshot(spark, sf, folder)
    return read_registered_users(spark, f"{folder}/users").select("accessKey")


_REGISTERED = f"WITH {t.ACCOUNTS} SELECT * FROM registered"


def q_read_group_members(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "groups")
    groups = group_member_parts(_members(spark, sf), 1_000).select(
        F.col("bucket").alias("groupName"), "members"
    )
    write_articles(groups, path, "json_array")
    return read_group_members(spark, path)


_GROUP_ROWS = f"WITH {t.ACCOUNTS} SELECT bucket, email FROM members"


def q_access_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_dir(spark, "snapshot")
    _write_snapshot(spark, sf, folder)
    return snapshot_plan(spark, folder)


def q_access_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots arrive; the plan of the later one is read."""
    base = shared_dir(spark, "refresh")
    for number in (1, 2):
        _write_snapshot(spark, sf, f"{base}/in/snapshot={number}")
    jobs.access_refresh(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.latest_plan(spark, f"{base}/out").drop("snapshot")


QUERIES = {
    "bucket_layout": (q_bucket_layout, _LAYOUT),
    "policy_document": (q_policy_document, _POLICY),
    "member_key": (q_member_key, _KEY),
    "regular_members": (q_regular_members, _REGULAR),
    "organization_members": (q_organization_members, _ORG_MEMBERS),
    "split_members": (q_split_members, _SPLIT),
    "group_members": (q_group_members, f"WITH {t.ACCOUNTS} SELECT DISTINCT bucket, email FROM members"),
    "group_members_in_parts": (q_group_members_in_parts, _groups_sql(20)),
    "access_plan": (q_access_plan, _PLAN),
    "group_drift": (q_group_drift, _DRIFT),
    "read_organizations": (q_read_organizations, _ORGS),
    "read_memberships": (q_read_memberships, _MEMBERSHIPS),
    "read_registered_users": (q_read_registered_users, _REGISTERED),
    "read_group_members": (q_read_group_members, _GROUP_ROWS),
    "access_snapshot": (q_access_snapshot, _PLAN),
    "access_refresh": (q_access_refresh, _PLAN),
}
