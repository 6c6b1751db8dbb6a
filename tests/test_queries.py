"""Every graph query with SQL against DuckDB on the smallest tables, and plans worth keeping."""

import decimal

import duckdb
import pytest

from graphloom.queries import PAIRS, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return f"{v:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = con.execute(SQL[name])
    at = [[d[0] for d in rel.description].index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


def test_every_pair_is_registered():
    assert set(PAIRS) <= set(QUERIES) == set(SQL)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_star_is_one_scan_with_pushed_filters(spark):
    plan = plan_of(QUERIES["filter_cmp"](spark, SF)).partition("== Physical Plan ==")[2]
    assert plan.count("FileScan parquet") == 1 and "GreaterThan(o_totalprice,100000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_joins_of_references_stay_on_keys(spark):
    plan = plan_of(QUERIES["bgp_join_3"](spark, SF)).partition("== Physical Plan ==")[2]
    assert "urn:row" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
