import hashlib
import random

import pytest

from citeloom.operators.access import (
    access_plan,
    bucket_layout,
    group_drift,
    group_member_parts,
    group_members,
    split_members,
)
from tests.helpers import rows


def _case(seed):
    pick = random.Random(seed)
    orgs = [(i, pick.choice(["Lab A", "lab-a", "Genes & Co", f"Org {i}"])) for i in range(8)]
    members = [
        (pick.randint(0, 9), n, f"u{n % 30}@x", pick.choice([True, False, False, None]))
        for n in range(60)
    ]
    members = [m for m in members if m[0] != 3] + [(3, 99, "boss@x", True)]
    registered = [f"u{n}@x" for n in range(0, 30, 3)]
    return orgs, members, registered


def _walk(orgs, members, registered):
    """One organization after another, as a loop over the three lists."""
    plan = []
    for org, title in orgs:
        bucket = "-".join(w for w in "".join(c if c.isalnum() else "-" for c in title).lower().split("-") if w)
        plan.append((org, bucket, 1, "make_bucket", None))
        kept = []
        for home, user, email, is_superuser in members:
            if home != org or is_superuser:
                continue
            if email not in registered:
                plan.append((org, bucket, 2, "register_user", email))
            kept.append(email)
        plan += [(org, bucket, 3, "add_to_group", e) for e in kept]
        if kept:
            plan += [(org, bucket, 4, "add_policy", None), (org, bucket, 5, "bind_policy", None)]
    return plan


@pytest.mark.parametrize("limit", ["10485760", "-1"])
@pytest.mark.parametrize("seed", [1, 2])
def test_access_plan_equals_a_walk(spark, seed, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    orgs, members, registered = _case(seed)
    got = access_plan(
        spark.createDataFrame(orgs, "id bigint, title string"),
        spark.createDataFrame(members, "organization bigint, id bigint, email string, is_superuser boolean"),
        spark.createDataFrame([(r,) for r in registered], "accessKey string"),
    )
    order = lambda plan: sorted(plan, key=str)
    columns = ("organization", "bucket", "step", "action", "email")
    assert order(tuple(r) for r in got.select(*columns).collect()) == order(_walk(orgs, members, registered))
    for row in got.where("action = 'register_user'").collect():
        ids = [m[1] for m in members if m[2] == row.email and m[0] == row.organization]
        assert row.member_key in {hashlib.md5(f"{row.email}:{i}".encode()).hexdigest() for i in ids}
    assert got.where("action = 'add_policy' AND policy LIKE '%arn:aws:s3:::%'").count() > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_new_user_in_two_organizations_is_planned_twice(spark):
    members = spark.createDataFrame([("a", "n@x"), ("b", "n@x"), ("b", None)], "bucket string, email string")
    registered = spark.createDataFrame([("o@x",), (None,)], "accessKey string")
    got = split_members(members, registered)
    assert got.where("NOT is_registered").count() == 3


def test_group_members(spark):
    members = spark.createDataFrame(
        [("a", f"u{i:03d}") for i in range(50)] + [("b", "y"), ("b", "x"), ("b", "x")],
        "bucket string, email string",
    )
    whole = [f"u{i:03d}" for i in range(50)]
    assert rows(group_members(members)) == [("a", e) for e in whole] + [("b", "x"), ("b", "y")]
    parts = [r for r in group_member_parts(members, 10).collect() if r.bucket == "a"]
    assert len(parts) > 3
    assert sorted(e for r in parts for e in r.members) == whole


def test_group_drift(spark):
    want = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "bucket string, email string")
    have = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "x")], "bucket string, email string")
    assert rows(group_drift(want, have)) == [("a", "x", "add"), ("a", "z", "remove"), ("b", "x", "remove")]


def test_bucket_layout(spark):
    orgs = spark.createDataFrame([(1, "Lab A"), (2, "lab-a")], "id int, title string")
    assert rows(bucket_layout(orgs), "object") == [
        (f"lab-a/{d}/.gitkeep",) for d in ("config", "html", "log", "metadata", "pdf")
    ]
