"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from canvass.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(name, spark, duck):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(ordered(mine), ordered(theirs), check_dtype=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_has_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
