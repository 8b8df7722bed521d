"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from kadenz.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
ROWS_ONLY = [n for n in catalog.queries() if n not in SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(float(v), 9) + 0.0) if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["j5_interval_containment", "j6_interval_overlap", "s10_tiers_on_a_grid"])
def test_interval_joins_have_no_nested_loop(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
