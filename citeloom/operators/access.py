"""Plans for storage accounts, groups and buckets from membership snapshots.

``orgs`` has ``id`` and ``title``; ``memberships`` has ``organization`` and the
user's ``id``, ``email`` and ``is_superuser``; ``registered`` has ``accessKey``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.accounts import policy_document
from citeloom.functions.paths import BUCKET_DIRS
from citeloom.functions.text import member_key, slug

# Order in which the actions of one bucket are to be carried out.
STEPS = {
    "make_bucket": 1,
    "register_user": 2,
    "add_to_group": 3,
    "add_policy": 4,
    "bind_policy": 5,
}


def with_bucket(orgs: DataFrame) -> DataFrame:
    return orgs.withColumn("bucket", slug(F.col("title")))


def bucket_layout(orgs: DataFrame) -> DataFrame:
    """Marker file of each folder in each bucket."""
    folders = F.explode(F.array(*[F.lit(d) for d in BUCKET_DIRS]))
    return (
        with_bucket(orgs)
        .select("bucket")
        .distinct()
        .select("bucket", folders.alias("directory"))
        .withColumn("object", F.concat_ws("/", "bucket", "directory", F.lit(".gitkeep")))
    )


def organization_members(orgs: DataFrame, memberships: DataFrame) -> DataFrame:
    """Users of each organization with the bucket they share."""
    homes = with_bucket(orgs).select(F.col("id").alias("organization"), "bucket")
    return memberships.join(homes, "organization")


def regular_members(users: DataFrame) -> DataFrame:
    """Users that are no superusers; one whose flag is not known is none."""
    return users.where(~F.coalesce("is_superuser", F.lit(False)))


def split_members(members: DataFrame, registered: DataFrame) -> DataFrame:
    """Add ``is_registered``: whether the member's email has an account.

    A new user in two organizations is marked as new in both.
    """
    known = (
        registered.where("accessKey is not null")
        .select(F.col("accessKey").alias("email"), F.lit(True).alias("_known"))
        .distinct()
    )
    return (
        members.join(known, "email", "left")
        .withColumn("is_registered", F.coalesce("_known", F.lit(False)))
        .select(*members.columns, "is_registered")
    )


def group_members(members: DataFrame) -> DataFrame:
    """``bucket, email`` of each group, one row per member.

    A group is a set, so each email counts once. Buckets without members do not
    appear.
    """
    return members.select("bucket", "email").distinct()


def group_member_parts(members: DataFrame, batch: int) -> DataFrame:
    """The members of each group in sorted arrays of about ``batch`` emails.

    For services that take members in requests of a bounded size. The parts of a
    group are told apart by ``part``; a hash deals the emails out.
    """
    emails = members.select("bucket", "email").distinct()
    sizes = emails.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.select("bucket", F.ceil(F.col("_n") / batch).alias("_parts"))
    hashed = F.conv(F.substring(F.md5("email"), 1, 8), 16, 10).cast("bigint")
    return (
        emails.join(parts, "bucket")
        .withColumn("part", F.pmod(hashed, F.col("_parts")))
        .groupBy("bucket", "part")
        .agg(F.array_sort(F.collect_list("email")).alias("members"))
    )


def access_plan(orgs: DataFrame, memberships: DataFrame, registered: DataFrame) -> DataFrame:
    """Actions that bring buckets, accounts and groups up to date.

    Every organization gets its bucket; regular members without an account are
    registered; if any regular member is left, the group is filled (one row
    per member) and the policy is added and bound. It is taken that every
    registration succeeds. Nothing is carried out.
    """
    regular = regular_members(memberships).select("organization", "id", "email")
    members = split_members(organization_members(orgs, regular), registered)
    per_member = members.select(
        "organization",
        "bucket",
        "email",
        member_key(F.col("email"), F.col("id")).alias("member_key"),
        F.explode(
            F.when(F.col("is_registered"), F.array(F.lit("add_to_group"))).otherwise(
                F.array(F.lit("register_user"), F.lit("add_to_group"))
            )
        ).alias("action"),
    )
    peopled = regular.select("organization").distinct().withColumn("_peopled", F.lit(True))
    per_bucket = (
        with_bucket(orgs)
        .select(F.col("id").alias("organization"), "bucket")
        .join(peopled, "organization", "left")
        .select(
            "organization",
            "bucket",
            F.explode(
                F.when(
                    F.col("_peopled"),
                    F.array(F.lit("make_bucket"), F.lit("add_policy"), F.lit("bind_policy")),
                ).otherwise(F.array(F.lit("make_bucket")))
            ).alias("action"),
        )
    )
    plan = per_member.unionByName(per_bucket, allowMissingColumns=True)
    steps: Column = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return plan.select(
        "organization",
        "bucket",
        steps[F.col("action")].alias("step"),
        "action",
        "email",
        F.when(F.col("action") == "register_user", F.col("member_key")).alias("member_key"),
        F.when(F.col("action") == "add_policy", policy_document(F.col("bucket"))).alias("policy"),
    )


def group_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Who to add to or remove from each group: ``(bucket, email, action)``.

    Both sides are marked and counted together, which takes one shuffle where
    a full outer join of distinct rows takes two.
    """
    keys = ["bucket", "email"]
    want = expected.select(*keys, F.lit(True).alias("_want"), F.lit(False).alias("_have"))
    have = actual.select(*keys, F.lit(False).alias("_want"), F.lit(True).alias("_have"))
    return (
        want.unionByName(have)
        .groupBy(*keys)
        .agg(F.max("_want").alias("_want"), F.max("_have").alias("_have"))
        .where("_want <> _have")
        .select(*keys, F.when(F.col("_want"), "add").otherwise("remove").alias("action"))
    )
