"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from haltwise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype == object:
            df[k] = df[k].map(lambda v: "" if v is None or v is pd.NA or v != v else str(v))
        else:
            df[k] = pd.to_numeric(df[k]).astype(float).round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = plain(catalog.queries()[name](spark, SF).toPandas())
    want = plain(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for k in got.columns:
        same = (got[k] == want[k]) | (got[k].isna() & want[k].isna())
        assert same.all(), (k, got[~same].head(), want[~same].head())
    assert np.isfinite(len(got))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
