import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators.dedup import (
    dedup_tally,
    duplicated_articles,
    new_pmids,
    unique_key_lookup,
    valid_pmids,
)
from citeloom.operators.firstfiles import build_index, load_index, merged_index, new_pmids_by_index, tally_by_index
from tests.helpers import plan_text, rows


def _walk(incoming, files):
    """Files one after another, ids taken out as they are found."""
    left, repeats, tally = [str(x) for x in incoming], [], []
    for name in sorted({f for f, _, _ in files}):
        records = [r for r in files if r[0] == name]
        held = {str(p) for _, p, _ in records if p not in (None, "", 0, "0")}
        found = [r for r in records if str(r[1]) in left and str(r[1]) in held]
        repeats += found
        before = len(left)
        left = [x for x in left if x not in held]
        tally.append((name, len(found), before - len(left), len(left)))
    return left, repeats, tally


def _random_case(seed, text_ids):
    pick = random.Random(seed)
    incoming = [pick.randint(1, 40) for _ in range(60)]
    files = [
        (f"f{pick.randint(0, 5)}.json", pick.choice([None, 0, *range(20, 70)]), n) for n in range(150)
    ]
    if text_ids:
        incoming = [str(x) for x in incoming] + ["007"]
    return incoming, files


@pytest.mark.parametrize("limit", ["10485760", "-1"])
@pytest.mark.parametrize("seed,text_ids", [(1, False), (2, True), (3, False)])
def test_dedup_equals_a_walk_over_files(spark, seed, text_ids, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        incoming, files = _random_case(seed, text_ids)
        kind = "string" if text_ids else "bigint"
        asked = spark.createDataFrame([(x,) for x in incoming], f"pmid {kind}")
        earlier = spark.createDataFrame(files, "file_name string, pmid bigint, n int")
        left, repeats, tally = _walk(incoming, files)
        assert sorted(str(r.pmid) for r in new_pmids(asked, earlier).collect()) == sorted(left)
        got = duplicated_articles(asked, earlier)
        assert rows(got, "file_name", "pmid", "n") == sorted(repeats)
        assert rows(dedup_tally(asked, earlier)) == tally
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_valid_pmids(spark):
    texts = spark.createDataFrame([("1",), ("",), ("0",), (None,), ("x",)], "pmid string")
    assert rows(valid_pmids(texts)) == [("1",), ("x",)]
    numbers = spark.createDataFrame([(1,), (0,), (None,)], "pmid bigint")
    assert rows(valid_pmids(numbers)) == [(1,)]


def test_unique_key_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "k string, v int")
    assert rows(unique_key_lookup(df, "k")) == [("a", 1)]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as contract

    plan = plan_text(contract.queries()["new_pmids"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "Not(EqualTo(l_orderkey,0))" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_of_first_files(spark):
    """Built from runs in any order it equals the records; the index is read where it lies."""
    files = {"b": [1, 1, 2, 0], "a": [2, 3], "c": [1, 4, 4, None], "d": [5, 3, 3]}
    records = [(f, p) for f, ids in files.items() for p in ids]
    earlier = spark.createDataFrame(records, "file_name string, pmid bigint")
    incoming = spark.createDataFrame([(x,) for x in (1, 2, 2, 4, 9, 3, 0, None)], "pmid bigint")
    # Broadcasting is off, so that a plan says what would be shuffled.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = build_index(earlier.where("file_name IN ('c', 'b')"))
        for name in ("d", "a"):
            index = merged_index(load_index(spark, index.table), earlier.where(F.col("file_name") == name))
        assert rows(index.rows) == [("1", "b", 2), ("2", "a", 1), ("3", "a", 1), ("4", "c", 2), ("5", "d", 1)]
        again = merged_index(index, earlier)
        assert rows(again.rows) == rows(index.rows)
        some = F.coalesce("pmid", F.lit(-1))
        assert rows(new_pmids_by_index(incoming, index), some) == rows(new_pmids(incoming, earlier), some)
        assert rows(tally_by_index(incoming, index, earlier)) == rows(dedup_tally(incoming, earlier))
        for found in (new_pmids_by_index(incoming, index), index.rows.join(incoming.select(F.col("pmid").cast("string").alias("_pmid_key")), "_pmid_key")):
            assert plan_text(found).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
