"""Every registered query with SQL gives the rows of its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = sorted(n for n in entry.oracle_sql() if n != "pipeline")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _rows(frame, names):
    def cell(v):
        if pd.isna(v):
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 5)

    return sorted(([cell(v) for v in r] for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    a, b = _rows(got, names), _rows(want, names)
    assert len(a) == len(b)
    assert all(x == y or all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1.0, abs(p)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_planned():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    for n in ("stateful_des", "data_sum", "event_raw"):
        assert n in queries
