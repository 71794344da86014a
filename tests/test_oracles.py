"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from hearth.plans import access, encounters, evaluation, exchange, extensions, features, notes, surveillance

PLANS = (surveillance, features, encounters, evaluation, exchange, notes, access, extensions)
CASES = [(name, plan) for plan in PLANS for name in plan.ORACLES]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(cell(r[i]) for i in order)) for r in rows))


@pytest.mark.parametrize("name,plan", CASES, ids=[c[0] for c in CASES])
def test_matches_sql(spark, sf, con, name, plan):
    df = plan.QUERIES[name](spark, sf)
    got = con.execute(plan.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, got.fetchall())


@pytest.mark.parametrize("name", [n for p in PLANS for n in p.QUERIES if n not in p.ORACLES])
def test_runs(spark, sf, name):
    query = next(p.QUERIES[name] for p in PLANS if name in p.QUERIES)
    assert query(spark, sf).count() > 0
