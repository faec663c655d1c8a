"""Daily states of the orders, from which every period is read.

The reports of a period, and the poll of the header every 30 seconds, need no
order twice: two small tables hold what a day adds up to.

* ``day_sums``: orders, amounts and how many amounts, per day and status.
* ``day_customers``: who ordered, as bitmaps of 32,768 customer numbers
  (Spark's bitmap aggregates), so customers of several days are counted once,
  exactly.

A day is (UTC date, IST date): trailing windows begin at a UTC midnight, business
days at 18:30 UTC, so each pair lies wholly inside or outside of any period.
Both tables are mergeable: the states of two sets of orders, or of an older
table and the orders since, add up (``merged_sums``, ``merged_customers``).
Orders without a date are a day of their own, which only "all time" has.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.functions.numbers import ratio
from thali.functions.temporal import TRAILING_DAYS, ist_date
from thali.operators.kpis import CANCELLED, COMPLETED_STATUSES, PENDING

DAY = ("utc_day", "ist_day")
_SUMS = ("orders", "amounts", "amount")


def _days(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("order_date").cast("date").alias("utc_day"), ist_date("order_date").alias("ist_day"),
                         "status", "total_amount", "user_id")


def day_sums(orders: DataFrame) -> DataFrame:
    """utc_day, ist_day, status, orders, amounts, amount."""
    return _days(orders).groupBy(*DAY, "status").agg(
        F.count(F.lit(1)).alias("orders"), F.count("total_amount").alias("amounts"),
        F.sum("total_amount").cast("decimal(38,2)").alias("amount"))


def merged_sums(*states: DataFrame) -> DataFrame:
    """The sums of several sets of orders together."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*DAY, "status").agg(*[F.sum(c).cast(states[0].schema[c].dataType).alias(c) for c in _SUMS])


def day_customers(orders: DataFrame) -> DataFrame:
    """utc_day, ist_day, bucket, customers (a bitmap)."""
    who = _days(orders).where(F.col("user_id").isNotNull())
    return who.groupBy(*DAY, F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("customers"))


def merged_customers(*states: DataFrame) -> DataFrame:
    """The customers of several sets of orders together."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*DAY, "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))


def _in_period(period: str, as_of: date, start: date | None, end: date | None) -> Column:
    """Whether a day lies in the period (the rules of ``period_filter``)."""
    if period == "today":
        return F.col("ist_day") == F.lit(as_of)
    if period in TRAILING_DAYS:
        return F.col("utc_day") >= F.lit(as_of - timedelta(days=TRAILING_DAYS[period]))
    if period == "custom" and start is not None and end is not None:
        return F.col("ist_day").between(F.lit(start), F.lit(end))
    return F.lit(True)


def _money(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")


def _orders(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("orders"))), F.lit(0)).cast("long")


def _one_row(sums: DataFrame, customers: DataFrame) -> DataFrame:
    """Two single rows as one."""
    both = sums.unionByName(customers, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def period_kpis(sums: DataFrame, customers: DataFrame, period: str = "all", as_of: date | None = None,
                start: date | None = None, end: date | None = None) -> DataFrame:
    """A1 from the daily states."""
    if as_of is None:
        raise ValueError("as_of is required")
    scope, today = _in_period(period, as_of, start, end), F.col("ist_day") == F.lit(as_of)
    status, counted = F.col("status"), F.col("status") != CANCELLED
    of = sums.where(scope | today).agg(
        _orders(scope).alias("total_orders"),
        _money(F.when(scope & counted, F.col("amount"))).alias("total_revenue"),
        ratio(F.sum(F.when(scope & counted, F.col("amount"))), F.sum(F.when(scope & counted, F.col("amounts")))).alias("avg_order_value"),
        _orders(scope & (status == PENDING)).alias("pending_orders"),
        _orders(scope & status.isin(*COMPLETED_STATUSES)).alias("completed_orders"),
        _orders(scope & (status == CANCELLED)).alias("cancelled_orders"),
        _orders(today).alias("today_orders"),
        _money(F.when(today & counted, F.col("amount"))).alias("today_revenue"))
    who = (customers.where(scope).groupBy("bucket").agg(F.bitmap_or_agg("customers").alias("customers"))
           .agg(F.coalesce(F.sum(F.bitmap_count("customers")), F.lit(0)).alias("total_customers")))
    return _one_row(of, who).select("total_orders", "total_revenue", "total_customers", "avg_order_value", "pending_orders",
                                    "completed_orders", "cancelled_orders", "today_orders", "today_revenue")


def header_counters(sums: DataFrame, as_of: date) -> DataFrame:
    """A2 from the daily sums: what the poll reads."""
    today = F.col("ist_day") == F.lit(as_of)
    return sums.agg(_orders(today).alias("today_orders"), _orders(F.col("status") == PENDING).alias("pending_orders"),
                    _money(F.when(today & (F.col("status") != CANCELLED), F.col("amount"))).alias("today_revenue"))


def daily_breakdown(sums: DataFrame, customers: DataFrame, start: date, end: date) -> DataFrame:
    """A7 of a range of business days from the daily states."""
    scope = _in_period("custom", start, start, end)
    of = sums.where(scope).groupBy(F.col("ist_day").alias("date")).agg(F.sum("orders").alias("order_count"), F.sum("amount").alias("_amount"))
    who = (customers.where(scope).groupBy(F.col("ist_day").alias("date"), "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))
           .groupBy("date").agg(F.sum(F.bitmap_count("customers")).alias("_customers")))
    amount = F.coalesce(F.col("_amount"), F.lit(0))
    return of.join(who, "date", "left").select(
        "date", "order_count", amount.cast("double").alias("total_revenue"), ratio(amount, F.col("order_count")).alias("avg_order"),
        F.coalesce("_customers", F.lit(0)).alias("customers")).orderBy("date")
