"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from heronry.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else repr(float(v) + 0.0) if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    if name in SQL:
        pd.testing.assert_frame_equal(normal(got), normal(duck.execute(SQL[name]).fetchdf()), check_dtype=False)
