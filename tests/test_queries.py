"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import answers, comparison, evidence, feeds, lexical, platform, search, understanding, upkeep

DATA = "/root/testdata/sf0.001"
PLANS = (search, lexical, platform, upkeep, understanding, evidence, answers, feeds, comparison)
QUERIES, SQL = {n: q for p in PLANS for n, q in p.QUERIES.items()}, {n: q for p in PLANS for n, q in p.SQL.items()}


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
