"""Every registered query against its comparison SQL, on the smallest tables."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from platewise.plans import comparison
from platewise.plans.queries import REGISTRY

DIRECTORY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = REGISTRY, comparison.SQL  # the text operators have tests of their own
ROWS_ONLY = {"sarimax_forecast", "ann_topk"}
# Queries whose rules need Python: Unicode folding, block products, series fits, the user's model.
PYTHON = {
    "normalize_name", "id_watermark", "evaluate_mapping", "topk_per_query", "cosine_topk", "ann_topk", "ann_topk_fixed", "candidate_union",
    "rerank", "component_limit", "map_to_root_items", "attach_nutrition", "sarimax_forecast", "llm_batch", "retry", "prompt_cache",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return None if math.isnan(value) else float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_all_but_the_approximate_have_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DIRECTORY)
    cursor = duck.execute(SQL[name])
    expected = table([c[0] for c in cursor.description], cursor.fetchall())
    assert table(found.columns, [tuple(r) for r in found.collect()]) == expected


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    """No query pairs rows without a key, and only the listed ones leave the JVM."""
    plan = QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin") + (() if name in PYTHON else ("Python", "Pandas")):
        assert node not in plan


def test_sarimax_rows(spark):
    forecast = QUERIES["sarimax_forecast"](spark, DIRECTORY).collect()
    assert len(forecast) == 10 * 28
    assert min(r["order_count"] for r in forecast) >= 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_date_filter_reaches_the_scan(spark):
    plan = QUERIES["vendor_daily_orders"](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
