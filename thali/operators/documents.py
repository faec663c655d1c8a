"""Order and customer documents and chart series as flat rows.

A document is rows of several sections: a header and its children, each with
the fields that the section has (the others are NULL).  The shape is the same
whatever the number of children, so no row, buffer or task holds all children
of a hot order or customer.  ``in_order`` spreads the rows by ranges of
(key, section, sort columns), so a large document lies over many tasks with its
rows in order.  ``nested`` builds the single-row form for a list of requested
ids, which is what the pages ask for.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.functions.text import ist_text, money_text
from thali.operators import catalog, geo, kpis, listings
from thali.operators.display import ORDER_STATUS, UNKNOWN

ADDRESS_FIELDS = ("address_line1", "address_line2", "landmark", "city", "state", "pincode", "latitude", "longitude")
#: Most ids that ``nested`` takes.
MOST_IDS = 1000


def _present(column: str) -> Column:
    """The IST text of a date that is there, else NULL."""
    return F.when(F.col(column).isNotNull(), ist_text(column))


def _mapped(rows: DataFrame) -> DataFrame:
    """``rows`` with the map link of their coordinates."""
    return rows.withColumn("map_link", geo.map_link(F.col("latitude"), F.col("longitude")))


def order_headers(orders: DataFrame, users: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row an order: its columns with formatted texts, and the customer
    with the default address."""
    customer = _mapped(listings.customer_default_address(users, addresses))
    fields = ("full_name", "phone", "email", *ADDRESS_FIELDS, "map_link")
    customer = customer.select(F.col("id").alias("_customer"), *[F.col(c).alias(f"customer_{c}") for c in fields])
    return (orders.join(customer, F.col("user_id") == F.col("_customer"), "left").drop("_customer")
            .withColumns({"order_date_formatted": _present("order_date"), "delivery_date_formatted": _present("delivery_date"),
                          "total_amount_formatted": money_text("total_amount")}))


def order_lines(order_items: DataFrame, services: DataFrame, menu: DataFrame) -> DataFrame:
    """One row an order line, with price texts; a line without a photo of its
    own gets the catalogue's."""
    lines = listings.order_lines_with_catalog(order_items, services, menu)
    own, other = F.col("item_photo"), F.col("item_photo_catalog")
    photo = F.when((F.coalesce(own, F.lit("")) == "") & (F.coalesce(other, F.lit("")) != ""), other).otherwise(own)
    return lines.withColumns({"item_photo": photo, "price_formatted": money_text("price"),
                              "total_formatted": money_text("total")}).drop("item_photo_catalog")


def order_payments(payments: DataFrame) -> DataFrame:
    """One row a payment, with its date text."""
    columns = [c for c in listings.PAYMENT_DETAIL_COLUMNS if c in payments.columns]
    return payments.select("order_id", *columns).withColumn("payment_date_formatted", _present("payment_date"))


def _sections(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in parts.items():
        rows = rows.withColumn("section", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def order_documents(orders: DataFrame, order_items: DataFrame, payments: DataFrame, users: DataFrame,
                    addresses: DataFrame, services: DataFrame, menu: DataFrame) -> DataFrame:
    """Per order one ``header`` row, its ``line`` and its ``payment`` rows."""
    return _sections({"header": order_headers(orders, users, addresses), "line": order_lines(order_items, services, menu),
                      "payment": order_payments(payments)})


ORDER_SORT = ("order_id", "section", "line_no", "item_id", "payment_id")


def customer_documents(users: DataFrame, addresses: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer one ``header`` row (profile, number of orders), its
    ``address`` rows (default first by the sort columns), a ``status`` row a
    status, and up to five ``recent`` orders."""
    total = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_orders"))
    header = (users.withColumnRenamed("id", "user_id").join(total, "user_id", "left")
              .withColumns({"total_orders": F.coalesce("total_orders", F.lit(0)).cast("long"),
                            "created_at_formatted": _present("created_at"), "last_login_formatted": _present("last_login")}))
    address = _mapped(addresses.select("user_id", "address_id", "is_default", *ADDRESS_FIELDS)).withColumn(
        "not_default", ~F.coalesce(F.col("is_default"), F.lit(False)))
    status = kpis.customer_status_summary(orders).select(
        "user_id", "status", F.col("count").alias("orders"), "total_amount")
    recent = listings.customer_recent_orders(orders).select(
        "user_id", "recent_rank", "order_id", F.col("total_amount").cast("double").alias("total_amount"), "status", "order_date")
    return _sections({"header": header, "address": address, "status": status, "recent": recent})


CUSTOMER_SORT = ("user_id", "section", "not_default", "address_id", "status", "recent_rank")


def in_order(documents: DataFrame, sort: Sequence[str], parts: int) -> DataFrame:
    """The rows spread over ``parts`` ranges of ``sort`` and sorted in each, so
    reading the parts one after another gives every document in order."""
    return documents.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)


def nested(documents: DataFrame, key: str, ids: Sequence[int], sort: Sequence[str]) -> DataFrame:
    """(key, section, rows[]) of the requested ids only, rows in order."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"nested documents are for up to {MOST_IDS} requested ids")
    inner = [c for c in sort if c not in (key, "section")]
    rest = [c for c in documents.columns if c not in (key, "section", *inner)]
    return (documents.where(F.col(key).isin(list(ids))).groupBy(key, "section")
            .agg(F.array_sort(F.collect_list(F.struct(*inner, *rest))).alias("rows")))


def _points(rows: DataFrame, chart: str, place: Column, label: Column, value: str, value2: str | None = None,
            color: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return rows.select(
        F.lit(chart).alias("chart"), place.cast("double").alias("place"), label.cast("string").alias("label"),
        F.col(value).cast("double").alias("value"), (F.col(value2) if value2 else nothing).cast("double").alias("value2"),
        (nothing if color is None else color).cast("string").alias("color"))


def chart_series(orders: DataFrame, order_items: DataFrame, payments: DataFrame, as_of: date) -> DataFrame:
    """The points of the four charts: chart, place (ascending order in the
    chart, ties by label), label, value, value2, color."""
    daily = kpis.daily_sales(orders, days=30, as_of=as_of)
    status = kpis.status_counts(orders)
    colors = F.create_map(*[F.lit(x) for s, v in ORDER_STATUS.items() for x in (s, v[1])])
    color = F.coalesce(F.element_at(colors, F.coalesce("status", F.lit(""))), F.lit(UNKNOWN[0]))
    top = kpis.top_items_by_name(order_items, 10)
    modes = kpis.payment_methods(payments)
    return (_points(daily, "daily_orders", F.unix_date("date"), F.col("label"), "order_count", "total_revenue")
            .unionByName(_points(status, "status_distribution", F.lit(0), F.initcap("status"), "count", color=color))
            .unionByName(_points(top, "top_items", -F.col("total_quantity"), F.col("item_name"), "total_quantity"))
            .unionByName(_points(modes, "payment_methods", -F.col("total_amount"), F.col("method"), "order_count", "total_amount")))
