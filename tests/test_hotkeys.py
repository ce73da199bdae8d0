import pytest
from pyspark.sql import functions as F

from citeloom.operators.hotkeys import hot_keys, split_join
from citeloom.operators.running import running_total
from tests.helpers import plan_text, rows


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key, a tenth on null, some unmatched."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 20))
    )
    return spark.range(0, 900, 1, 6).select("id", key.alias("k"))


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3), ("gone", 4)], "k string, v int")


def test_hot_keys(skewed):
    got = {r.k: r._salts for r in hot_keys(skewed, ["k"], 50).collect()}
    assert got == {"hot": 6, None: 2}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(skewed, lookup, how, no_broadcast):
    want = sorted(map(str, skewed.join(lookup, ["k"], how).collect()))
    got = split_join(skewed, lookup, ["k"], how, hot_rows=50)
    assert sorted(map(str, got.collect())) == want


def test_hot_rows_are_spread(skewed, lookup, no_broadcast):
    spark = skewed.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    joined = split_join(skewed, lookup, ["k"], "inner", hot_rows=10)
    tasks = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 2
    assert "_salt" in plan_text(joined)


def test_running_total(spark):
    values = spark.range(0, 2000, 1, 5).select(
        F.format_string("f%05d", F.col("id") * 7 % 2000).alias("name"), (F.col("id") % 13).alias("n")
    )
    got = {r.name: r.so_far for r in running_total(values, "name", "n", "so_far").collect()}
    total, want = 0, {}
    for name, n in rows(values):
        total += n
        want[name] = total
    assert got == want


def test_running_total_of_few_rows(spark):
    one = spark.createDataFrame([("a", 3)], "name string, n bigint")
    assert rows(running_total(one, "name", "n", "s")) == [("a", 3, 3)]
    assert rows(running_total(one.where("false"), "name", "n", "s")) == []
