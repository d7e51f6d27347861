"""Queries against DuckDB over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from factweave import catalog


def norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, db, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"stream_projection"}))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
