"""Every query against DuckDB on the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from tests.conftest import ROOT
from tidemark.plans.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, con, name):
    df = queries()[name](spark, sf)
    got = con.execute(oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, ([plain(v) for v in r] for r in got.fetchall())))
    assert sorted(map(repr, ([plain(v) for v in r] for r in df.select(columns).collect()))) == want


def test_scans_read_few_columns(spark, sf):
    plan = queries()["tbspc_daily"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan and "l_extendedprice" not in plan


def test_smoothing_queries(spark, sf):
    """No SQL for these: rows, bounds and freshness."""
    rows = queries()["esm_forecast"](spark, sf).collect()
    future = [r for r in rows if r["actual"] is None]
    assert future and all(r["lower_bound"] <= r["prediction"] <= r["upper_bound"] for r in future)
    assert all(r["day_dt"] > r["trained_through"] for r in future)
    points = queries()["esm_compare"](spark, sf).where("engine = 'ESM'").collect()
    assert points and {r["horizon_days"] for r in points} == {30}


def test_entry_without_a_dependency():
    """Where the text operators can't be imported, all other queries are there."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(queries())), str(len(oracle_sql())), "False"], out.stderr
