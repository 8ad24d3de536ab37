"""Every registered query against DuckDB on the same tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from relq.plans import queries as registered

TABLES = "region nation customer supplier part orders lineitem events".split()
RUN, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{v.normalize():f}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(RUN))
def test_same_rows_as_duckdb(spark, sf, db, name):
    df = RUN[name](spark, sf)
    want = db.sql(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(RUN) == set(SQL)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = RUN["filter_compound"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in text and "o_custkey" not in text.split("ReadSchema")[1]


def test_exists_becomes_a_semi_join(spark, sf):
    for name, kind in (("exists_correlated", "LeftSemi"), ("not_exists", "LeftAnti"), ("in_subquery", "LeftSemi"), ("exists_or", "ExistenceJoin")):
        assert kind in RUN[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_first_of_a_correlated_query_follows_its_order(spark, sf):
    """The order must reach the plan's window: a sort below a shuffle decides nothing."""
    from relq.functions import row_number
    from relq.functions.expr import Window
    from relq.plans.compiler import Compiler
    from relq.plans.queries import catalog
    from relq.sources.star import Orders

    plan = RUN["scalar_first"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(o_custkey" in plan and "o_totalprice" in plan.split("windowspecdefinition", 1)[1].split("specifiedwindowframe")[0]
    q = Orders.query().order_by(lambda o: o.o_orderkey.desc()).limit(3).select(lambda o: {"n": row_number().over(Window().order_by(o.o_orderkey))})
    n = Compiler(catalog(spark, sf)).query(Orders.query()).count()
    assert [r.n for r in Compiler(catalog(spark, sf)).query(q).collect()] == [n, n - 1, n - 2]
