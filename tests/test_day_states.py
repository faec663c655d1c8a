"""Daily states give what the reports over orders give, and add up."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fixtures import orders as edge_orders
from thali.operators import day_states, kpis
from thali.sources.tables import load_tables

AS_OF = date(1998, 7, 1)
START, END = date(1998, 5, 3), date(1998, 6, 20)


@pytest.fixture(scope="module")
def orders(spark):
    edges = edge_orders(spark).select("order_id", "user_id", "status", "total_amount", "order_date")
    near = [(100 + i, u, s, Decimal(a) if a else None, at) for i, (u, s, a, at) in enumerate([
        (7, "pending", "1.10", datetime(1998, 6, 30, 18, 29, 59)), (7, "cancelled", "2.20", datetime(1998, 6, 30, 18, 30)),
        (8, "delivered", "3.30", datetime(1998, 7, 1, 18, 29, 59)), (None, "completed", "4.40", datetime(1998, 6, 24)),
        (2 ** 40 + 1, "pending", "5.50", datetime(1998, 6, 23, 23, 59, 59)), (-5, None, None, datetime(1998, 6, 24, 1))])]
    more = spark.createDataFrame(near, "order_id long, user_id long, status string, total_amount decimal(18,2), order_date timestamp_ntz")
    whole = load_tables(spark, SF_SMALL, ("orders",))["orders"].select(*edges.columns)
    return whole.unionByName(edges).unionByName(more)


@pytest.mark.parametrize("period", ["all", "today", "week", "month", "custom"])
def test_periods(orders, period):
    got = day_states.period_kpis(day_states.day_sums(orders), day_states.day_customers(orders), period, AS_OF, START, END)
    want = kpis.period_kpis(orders, period, AS_OF, START, END)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_header_and_days(orders):
    sums, who = day_states.day_sums(orders), day_states.day_customers(orders)
    assert day_states.header_counters(sums, AS_OF).collect() == kpis.header_counters(orders, AS_OF).collect()
    got, want = day_states.daily_breakdown(sums, who, START, END), kpis.daily_breakdown(orders, start=START, end=END)
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_states_add_up(orders):
    old, new = orders.where("order_id % 3 = 0"), orders.where("order_id % 3 <> 0")
    sums = day_states.merged_sums(day_states.day_sums(old), day_states.day_sums(new))
    who = day_states.merged_customers(day_states.day_customers(old), day_states.day_customers(new))
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(sums) == rows(day_states.day_sums(orders).select(*sums.columns))
    count = lambda df: df.select(F.sum(F.bitmap_count("customers"))).first()[0]
    assert count(who) == count(day_states.day_customers(orders))
    assert day_states.period_kpis(sums, who, "month", AS_OF).collect() == kpis.period_kpis(orders, "month", AS_OF).collect()


def test_no_orders(orders):
    none = orders.limit(0)
    got = day_states.period_kpis(day_states.day_sums(none), day_states.day_customers(none), "all", AS_OF)
    assert got.collect() == kpis.period_kpis(none, "all", AS_OF).collect()
