"""Every registered query against its SQL on the test tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(dtype) -> str:
    text = str(dtype)
    return "text" if text in ("object", "str", "string") else text


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    # Whole numbers with nulls among them are doubles on the one side, Int64 on the other.
    frame = frame.astype({c: "float64" for c in columns if str(frame[c].dtype) == "Int64"})
    return frame[columns].sort_values(columns, na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    got = _sorted(QUERIES[name](spark, sf_dir).toPandas())
    want = _sorted(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert [_kind(x) for x in got.dtypes] == [_kind(x) for x in want.dtypes]
    for column in got.columns:
        left, right = got[column], want[column]
        same = (left == right) | (left.isna() & right.isna())
        assert same.all(), (column, left[~same].head().tolist(), right[~same].head().tolist())


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "file_name",
        "duplicated_records",
        "removed_ids",
        "ids_left",
    ]
