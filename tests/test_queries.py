"""Every registered query against SQL on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from notelattice.plans import ORACLES, QUERIES


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal, float)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = [df.columns.index(c) for c in sorted(df.columns)], [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(tuple(plain(r[k]) for k in a) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in b) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("extract_all_long", "graph_retrieve", "daily_report", "blend_weighted", "contradictions"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
