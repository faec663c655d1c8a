"""Plan properties: pushdown, scans and exchanges of the registered queries,
top-k below joins, group limits, no Python evaluation and no cross product."""

import os
import re
from datetime import date

import pytest

from conftest import SF_SMALL
from thali.operators import kpis, listings
from thali.plans import REGISTRY
from thali.sources.tables import load_tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffled(spark):
    """As tables too large to broadcast are planned."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _query(spark, key):
    return _plan(REGISTRY[key].build(spark, SF_SMALL))


def test_ist_day_range_pushed_to_scan(spark, scratch):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"]
    path = os.path.join(scratch, "orders")
    orders.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = _plan(kpis.period_kpis(stored, "custom", as_of=date(2001, 7, 31),
                                  start=date(2001, 5, 1), end=date(2001, 7, 15)))
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(order_date" in pushed and "LessThan(order_date" in pushed
    assert plan.count("FileScan parquet") == 1  # both statements of the reference share one scan


@pytest.mark.parametrize("key", ["period_kpis_today", "period_kpis_custom", "daily_sales_custom", "todays_orders"])
def test_registered_days_bound_the_stored_date(spark, key):
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", _query(spark, key))


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_no_cross_product_without_broadcasts(spark, shuffled, key):
    plan = _query(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("key, scans, exchanges", [
    ("status_counts", 1, 1), ("order_display", 1, 0), ("order_status_labels", 2, 2), ("category_sales", 1, 2), ("items_listing", 3, 3)])
def test_names_are_joined_only_where_read(spark, shuffled, key, scans, exchanges):
    plan = _query(spark, key)
    assert plan.count("FileScan parquet") == scans
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)) == exchanges


@pytest.mark.parametrize("key, scans", [("status_distribution", 1), ("payment_methods", 1), ("customer_acquisition", 1),
                                        ("apply_status_changes", 3), ("status_history", 3), ("apply_payment_changes", 4)])
def test_orders_scans(spark, shuffled, key, scans):
    plan = _query(spark, key)
    assert len(re.findall(r"FileScan parquet \[[^]]*o_orderkey|FileScan parquet \[[^]]*o_custkey|FileScan parquet \[[^]]*o_order", plan)) <= scans


@pytest.mark.parametrize("key", ["orders_page", "orders_page_filtered", "orders_page_search", "orders_page_revenue", "todays_orders", "customers_page"])
def test_the_page_is_taken_before_the_joins(spark, shuffled, key):
    plan = _query(spark, key)
    depth = lambda name: [len(re.match(r"[^A-Za-z*]*", x)[0]) for x in plan.split("\n") if re.search(rf"\b{name}\b", x)]
    assert max(depth("TakeOrderedAndProject")) > min(depth("SortMergeJoin"))
    assert "lineitem" not in plan or "BroadcastHashJoin" in plan  # lines meet the page's keys before their shuffle


def test_recent_orders_use_group_limit_before_the_only_shuffle(spark, shuffled):
    plan = _query(spark, "customer_recent_orders")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_no_python_evaluation(spark, key):
    df = REGISTRY[key].build(spark, SF_SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in plan


def test_pages_use_listing_rows(spark):
    t = load_tables(spark, SF_SMALL)
    page = listings.orders_page(t["orders"], t["order_items"], t["payments"], 3)
    whole = listings.orders_listing(t["orders"], t["order_items"], t["payments"]).orderBy(*listings._listing_sort())
    assert page.collect() == whole.offset(40).limit(20).select(*page.columns).collect()
