"""Reports and KPIs.

All aggregates run as partial (map-side) + final hash aggregates, so a
customer or status holding a third of the rows costs no more than any
other: only one partial row per key and task crosses the shuffle.  Reports
that the reference issues as several statements over ``orders`` are one
conditional aggregate here, so ``orders`` is scanned once.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.functions.numbers import money, money_sum, pct0, pct1, ratio
from thali.functions.ordering import order_desc
from thali.functions.temporal import ist_date, ist_timestamp, ntz, on_ist_days, period_filter

# Order status domain and its groupings.
COMPLETED_STATUSES = ("completed", "delivered")
CANCELLED = "cancelled"
PENDING = "pending"


def _not_cancelled() -> Column:
    # NULL status gives NULL here, so CASE/WHERE treat it as "not revenue" (R8).
    return F.col("status") != CANCELLED


def period_kpis(orders: DataFrame, period: str = "all", as_of: date | None = None,
                start: date | None = None, end: date | None = None) -> DataFrame:
    """A1: one row of period KPIs plus today's orders and revenue.

    Rows are filtered to ``period OR today`` and each KPI is a conditional
    aggregate, so both of the reference's statements share one scan.
    """
    if as_of is None:
        raise ValueError("as_of is required")
    ts = F.col("order_date")
    in_period = period_filter(ts, period, as_of, start, end)
    today = on_ist_days(ts, as_of)
    base = orders.select("order_date", "status", "total_amount", "user_id")
    if in_period is not None:
        base = base.where(in_period | today)
        scope = in_period
    else:
        scope = F.lit(True)
    amount = F.col("total_amount")
    nc = _not_cancelled()

    def p(value: Column) -> Column:
        return F.when(scope, value)

    return base.agg(
        F.count(p(F.lit(1))).alias("total_orders"),
        money_sum(p(F.when(nc, amount).otherwise(F.lit(0)))).alias("total_revenue"),
        F.count_distinct(p(F.col("user_id"))).alias("total_customers"),
        ratio(F.sum(p(F.when(nc, amount))), F.count(p(F.when(nc, amount)))).alias("avg_order_value"),
        F.count(p(F.when(F.col("status") == PENDING, 1))).alias("pending_orders"),
        F.count(p(F.when(F.col("status").isin(*COMPLETED_STATUSES), 1))).alias("completed_orders"),
        F.count(p(F.when(F.col("status") == CANCELLED, 1))).alias("cancelled_orders"),
        F.count(F.when(today, 1)).alias("today_orders"),
        money_sum(F.when(today, F.when(nc, amount).otherwise(F.lit(0)))).alias("today_revenue"),
    )


def header_counters(orders: DataFrame, as_of: date) -> DataFrame:
    """A2: today's orders, all-time pending orders, today's non-cancelled revenue."""
    today = on_ist_days("order_date", as_of)
    return orders.select("order_date", "status", "total_amount").agg(
        F.count(F.when(today, 1)).alias("today_orders"),
        F.count(F.when(F.col("status") == PENDING, 1)).alias("pending_orders"),
        money_sum(F.when(today & _not_cancelled(), F.col("total_amount"))).alias("today_revenue"),
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    """A3: count and share (1 decimal) of all orders per status, largest first.

    The total is the sum of the grouped rows, so the table is read once.
    """
    return (
        orders.groupBy("status").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("percentage", pct1(F.col("count"), F.sum("count").over(Window.partitionBy())))
        .orderBy(*order_desc("count", "status"))
    )


def status_counts(orders: DataFrame) -> DataFrame:
    """A4: orders per status (NULL status is its own group)."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def status_count_row(orders: DataFrame, statuses: tuple[str, ...] = (
        "pending", "processing", "completed", "cancelled", "delivered")) -> DataFrame:
    """A4 pivoted to one row; a status with no orders shows 0."""
    return orders.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses],
                      F.count(F.lit(1)).alias("all"))


def top_items(order_items: DataFrame, k: int = 10) -> DataFrame:
    """A5: top ``k`` (name, type) pairs by quantity, with revenue."""
    return (
        order_items.groupBy("item_name", "item_type")
        .agg(F.sum("quantity").alias("total_quantity"), money(F.sum("total")).alias("total_revenue"))
        .orderBy(*order_desc("total_quantity", "item_name", "item_type"))
        .limit(k)
    )


def _daily(orders: DataFrame, start: date | None, end: date | None, days: int | None,
           as_of: date | None) -> DataFrame:
    ts = F.col("order_date")
    if start is not None and end is not None:
        pred = on_ist_days(ts, start, end)
    else:
        if as_of is None:
            raise ValueError("as_of is required for a trailing window")
        pred = ts >= ntz(as_of - timedelta(days=7 if days is None else days))
    return orders.select("order_date", "total_amount", "user_id").where(pred) \
        .withColumn("date", ist_date("order_date"))


def daily_sales(orders: DataFrame, start: date | None = None, end: date | None = None,
                days: int | None = None, as_of: date | None = None) -> DataFrame:
    """Orders and revenue per IST day (cancelled orders included).

    A custom range filters on the IST day; otherwise the trailing ``days``
    (7 or 30) compare the raw timestamp.  Days without orders are absent.
    """
    return (
        _daily(orders, start, end, days, as_of).groupBy("date")
        .agg(F.count(F.lit(1)).alias("order_count"), money_sum("total_amount").alias("total_revenue"))
        .withColumn("label", F.date_format("date", "MMM dd"))
        .orderBy("date")
    )


def daily_breakdown(orders: DataFrame, start: date | None = None, end: date | None = None,
                    days: int | None = None, as_of: date | None = None) -> DataFrame:
    """A6 plus average per order and distinct customers per day."""
    return (
        _daily(orders, start, end, days, as_of).groupBy("date")
        .agg(F.count(F.lit(1)).alias("order_count"),
             F.sum("total_amount").alias("_rev"),
             F.count_distinct("user_id").alias("customers"))
        .select("date", "order_count",
                F.coalesce(money("_rev"), F.lit(0.0)).alias("total_revenue"),
                ratio(F.coalesce(F.col("_rev"), F.lit(0)), F.col("order_count")).alias("avg_order"),
                "customers")
        .orderBy("date")
    )


def category_sales(order_items: DataFrame) -> DataFrame:
    """Order lines and revenue per item type, revenue descending."""
    return (
        order_items.groupBy(F.col("item_type").alias("category"))
        .agg(F.count(F.lit(1)).alias("order_count"), money(F.sum("total")).alias("total_revenue"))
        .orderBy(*order_desc("total_revenue", "category"))
    )


def payment_methods(payments: DataFrame) -> DataFrame:
    """Completed payments per mode: count, amount and whole-% share of the count.

    Grouping is on the raw mode, so a NULL mode and a literal ``Unknown``
    stay two rows, both shown as ``Unknown``.
    """
    done = payments.where(F.col("payment_status") == "completed")
    total = F.sum("order_count").over(Window.partitionBy())  # over the grouped rows
    return (
        done.groupBy("payment_mode")
        .agg(F.count(F.lit(1)).alias("order_count"), money(F.sum("amount")).alias("total_amount"))
        .select(F.coalesce("payment_mode", F.lit("Unknown")).alias("method"),
                "order_count", "total_amount",
                pct0(F.col("order_count"), total).alias("share"))
        .orderBy(*order_desc("total_amount", "method"))
    )


def top_items_by_name(order_items: DataFrame, k: int = 10) -> DataFrame:
    """A10: top ``k`` item names by quantity."""
    return (
        order_items.groupBy("item_name").agg(F.sum("quantity").alias("total_quantity"))
        .orderBy(*order_desc("total_quantity", "item_name"))
        .limit(k)
    )


def customer_status_summary(orders: DataFrame) -> DataFrame:
    """Per customer and status, order count and amount (all customers at once)."""
    return orders.groupBy("user_id", "status").agg(
        F.count(F.lit(1)).alias("count"), money(F.sum("total_amount")).alias("total_amount"))


def status_summary(kpis: DataFrame) -> DataFrame:
    """Pending / processing / completed / cancelled / total with % of total.

    processing = total - pending - completed - cancelled, as on the page;
    ``completion_rate`` (completed share) is filled in on every row.
    """
    t = F.col("total_orders")
    processing = t - F.col("pending_orders") - F.col("completed_orders") - F.col("cancelled_orders")
    parts = [("pending", F.col("pending_orders")), ("processing", processing),
             ("completed", F.col("completed_orders")), ("cancelled", F.col("cancelled_orders"))]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("part"), c.cast("long").alias("orders"),
                     pct1(c, t).alias("percentage")) for i, (n, c) in enumerate(parts)]
    rows.append(F.struct(F.lit(len(parts)).alias("ord"), F.lit("total").alias("part"),
                         t.cast("long").alias("orders"),
                         F.when(t > 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("percentage")))
    return (
        kpis.select(F.explode(F.array(*rows)).alias("r"),
                    pct1(F.col("completed_orders"), t).alias("completion_rate"))
        .select("r.part", "r.orders", "r.percentage", "completion_rate", "r.ord")
        .orderBy("ord").drop("ord")
    )


def revenue_summary(kpis: DataFrame) -> DataFrame:
    """Revenue lines of the statistics page, value and ``₹%.2f`` text.

    Lifetime value = revenue / customers, 0 without customers.
    """
    from thali.functions.text import money_plain_text

    lifetime = ratio(F.col("total_revenue"), F.col("total_customers"))
    metrics = [("total_revenue", F.col("total_revenue")), ("today_revenue", F.col("today_revenue")),
               ("avg_order_value", F.col("avg_order_value")),
               ("total_customers", F.col("total_customers").cast("double")),
               ("lifetime_value", lifetime)]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), c.cast("double").alias("value"))
            for i, (n, c) in enumerate(metrics)]
    out = kpis.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return (
        out.withColumn("text", F.when(F.col("metric") == "total_customers",
                                      F.col("value").cast("long").cast("string"))
                       .otherwise(money_plain_text(F.col("value"))))
        .orderBy("ord").drop("ord")
    )


def customer_base_stats(customers: DataFrame) -> DataFrame:
    """Customers total, active, recently active, with orders, with > 5 orders,
    total and highest spend, over every customer row (``customers`` = J7 output)."""
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count(F.when(F.col("is_active"), 1)).alias("active_customers"),
        F.count(F.col("last_login")).alias("recently_active"),
        F.count(F.when(F.col("total_orders") > 0, 1)).alias("with_orders"),
        F.count(F.when(F.col("total_orders") > 5, 1)).alias("frequent_customers"),
        money_sum("total_spent").alias("total_spent"),
        F.coalesce(F.max("total_spent").cast("double"), F.lit(0.0)).alias("top_spend"),
    )


def page_revenue(page: DataFrame) -> DataFrame:
    """Sum of ``total_amount`` over one listing page."""
    return page.agg(F.coalesce(F.sum("total_amount"), F.lit(0.0)).cast("double").alias("page_revenue"))


def hourly_orders(orders: DataFrame) -> DataFrame:
    """Orders per IST hour of day, all 24 hours, 0 filled.

    The 24-row spine is a fixed-size frame, so broadcasting it is bounded.
    """
    spark = orders.sparkSession
    counts = (orders.where(F.col("order_date").isNotNull())
              .groupBy(F.hour(ist_timestamp("order_date")).alias("hour"))
              .agg(F.count(F.lit(1)).alias("orders")))
    spine = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return (F.broadcast(spine).join(counts, "hour", "left")
            .select("hour", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))
            .orderBy("hour"))


def customer_acquisition(orders: DataFrame) -> DataFrame:
    """Per IST month, customers whose first order falls in it (new) and
    distinct customers ordering in it whose first order was earlier (repeat).

    One distinct (customer, month); a customer's first month is the least of
    its rows there, one a month however many orders it has.
    """
    active = orders.where(F.col("order_date").isNotNull() & F.col("user_id").isNotNull()) \
        .select("user_id", F.date_trunc("month", ist_timestamp("order_date")).alias("m")).distinct()
    return (
        active.withColumn("first_m", F.min("m").over(Window.partitionBy("user_id")))
        .groupBy(F.to_date("m").alias("month"))
        .agg(F.count(F.when(F.col("m") == F.col("first_m"), 1)).alias("new_customers"),
             F.count(F.when(F.col("m") > F.col("first_m"), 1)).alias("repeat_customers"))
        .withColumn("label", F.date_format("month", "MMM yyyy"))
        .orderBy("month")
    )


def delivered_count(orders: DataFrame) -> DataFrame:
    """Orders whose status is ``delivered``."""
    return orders.agg(F.count(F.when(F.col("status") == "delivered", 1)).alias("delivered_orders"))

