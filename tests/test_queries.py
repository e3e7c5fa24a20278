"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from traceloom.plans import registry

registry.load()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: May be empty on the smallest tables.
MAY_BE_EMPTY = {"v3_extended", "r10_example_steps", "b11_resume", "p22_failed_files"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 8) + 0.0) if not float(v).is_integer() else str(int(v))
    return str(v)


def table(df):
    df = df[sorted(df.columns)].map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) or name in MAY_BE_EMPTY
    pd.testing.assert_frame_equal(table(got), table(want))
