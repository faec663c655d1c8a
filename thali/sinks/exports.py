"""CSV exports, snapshots and the activity log.

Writers are distributed: each task writes its own part file; nothing is
collected to the driver.  Exports write a header per part file (Spark's
CSV writer), and the folder is the export.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.functions.temporal import TRAILING_DAYS
from thali.operators import kpis, listings


def _csv(df: DataFrame, path: str) -> str:
    # Nested or binary values have no CSV form; timestamps are written as ISO text.
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_orders_frame(orders: DataFrame, order_items: DataFrame, payments: DataFrame, **filters) -> DataFrame:
    """K1 frame: the filtered orders listing, all rows, in listing order."""
    listing = listings.orders_listing(orders, order_items, payments, **filters)
    return listing.orderBy(*listings._listing_sort())


def export_orders(orders: DataFrame, order_items: DataFrame, payments: DataFrame, path: str, **filters) -> str:
    """K1: write the filtered listing as CSV."""
    return _csv(export_orders_frame(orders, order_items, payments, **filters), path)


def export_selected_frame(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """K2 frame: the listed orders (``ids`` has ``order_id``)."""
    return orders.join(ids.select("order_id").distinct(), "order_id", "left_semi")


def export_selected_orders(orders: DataFrame, ids: DataFrame, path: str) -> str:
    """K2: write the listed orders as CSV."""
    return _csv(export_selected_frame(orders, ids), path)


def export_customers_frame(users: DataFrame, orders: DataFrame, search: str | None = None) -> DataFrame:
    """K3 frame: the customer listing without paging, newest first."""
    return listings.customers_sorted(listings.customers_listing(users, orders, search), "newest")


def export_customers(users: DataFrame, orders: DataFrame, path: str, search: str | None = None) -> str:
    """K3: write the customer listing as CSV."""
    return _csv(export_customers_frame(users, orders, search), path)


def statistics_sections(orders: DataFrame, order_items: DataFrame, payments: DataFrame, period: str,
                        as_of: date, start: date | None = None, end: date | None = None) -> dict[str, DataFrame]:
    """K4 sections: KPIs and daily rows of the period (a trailing window's own
    days, else 7), category and payment-method frames."""
    daily = (kpis.daily_sales(orders, start=start, end=end, as_of=as_of)
             if period == "custom" and start and end else kpis.daily_sales(orders, days=TRAILING_DAYS.get(period, 7), as_of=as_of))
    return {
        "kpis": kpis.period_kpis(orders, period, as_of, start, end),
        "daily": daily,
        "categories": kpis.category_sales(order_items),
        "payment_methods": kpis.payment_methods(payments),
    }


def export_statistics(orders: DataFrame, order_items: DataFrame, payments: DataFrame, period: str, as_of: date,
                      path: str, start: date | None = None, end: date | None = None) -> dict[str, str]:
    """K4: one CSV folder per section under ``path``."""
    return {name: _csv(df, f"{path.rstrip('/')}/{name}")
            for name, df in statistics_sections(orders, order_items, payments, period, as_of, start, end).items()}


ACTIVITY_SCHEMA = ("user_id int, activity_type string, description string, ip_address string, "
                   "user_agent string, created_at timestamp_ntz")


def append_activity(activity: DataFrame, path: str, batch: str) -> str:
    """K5: append a batch's activity rows to the log (parquet, a folder a batch).

    A batch that is written again, by a rerun or a retry, replaces its own
    rows and no others, so each action is in the log once.
    """
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError("a batch name has letters, digits, dots, dashes and underscores")
    cols = [c.split()[0] for c in ACTIVITY_SCHEMA.split(", ")]
    types = [c.split()[1] for c in ACTIVITY_SCHEMA.split(", ")]
    activity.select(*[F.col(c).cast(t).alias(c) for c, t in zip(cols, types)]) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return path


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """The activity log, every batch once."""
    return spark.read.schema(ACTIVITY_SCHEMA).parquet(path).drop("batch")


def write_snapshot(df: DataFrame, base: str, version: str | int, partition_by: str | None = None) -> str:
    """Write a new table version to ``base/v=<version>`` (never in place).

    ``orders`` snapshots can be partitioned by IST month so later period
    queries prune files.
    """
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path
