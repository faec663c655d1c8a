"""Joins, searches, listings, pages and per-customer windows
(SURVEY §2.4 F1-F4/F8/F9, §2.5 J1-J7/J9, §2.7 W1-W2, §2.8 T1/T2/O1-O3).

Scale notes
-----------
* Child tables are aggregated to one row per key *before* joining
  (J1, J2, J7), so joins are 1:1 or 1:few on ``order_id`` / ``user_id`` and
  a hot key never multiplies rows.  A hot key on the big side of a
  sort-merge join is split by AQE's skew-join handling.
* No side is hinted for broadcast: catalogue and dimension sizes grow with
  the data, so the choice is left to the size-checked
  ``autoBroadcastJoinThreshold`` and AQE's runtime statistics.
* Top-k per key (W1, W2) is ``row_number() <= k``, which Spark plans with a
  partial ``WindowGroupLimit`` before the shuffle, so at most ``k`` rows per
  key and map task are shuffled even for a customer holding a third of
  all orders.
* Pages take their top-k orders or customers first and join lines, payments
  and names to those; deep pages use ``keyset_after`` (a range predicate on the
  sort key) instead of offsets.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.functions.ordering import order_desc, pg_asc, pg_desc
from thali.functions.temporal import on_ist_days, on_utc_days
from thali.operators.ranges import in_ranges, numbered

PAGE_SIZE = 20
# Status -> badge as the recent-activity list writes it (no delivered).
ACTIVITY_BADGE = {"pending": "warning", "processing": "info", "completed": "success", "cancelled": "danger"}


# --- filters -----------------------------------------------------------------

def _contains(text: str) -> str:
    # Not escaped: % and _ in the search text act as wildcards (R11, kept).
    return f"%{text}%"


def search_orders(orders: DataFrame, text: str | None) -> DataFrame:
    """case-insensitive contains over name, phone, email or order id text."""
    if not text:
        return orders
    p = _contains(text)
    return orders.where(
        F.col("user_name").ilike(p) | F.col("user_phone").ilike(p) | F.col("user_email").ilike(p)
        | F.col("order_id").cast("string").ilike(p))


def search_customers(users: DataFrame, text: str | None) -> DataFrame:
    """case-insensitive contains over full name, phone, email."""
    if not text:
        return users
    p = _contains(text)
    return users.where(F.col("full_name").ilike(p) | F.col("phone").ilike(p) | F.col("email").ilike(p))


def filter_orders(orders: DataFrame, status: str | None = None, start: date | None = None,
                  end: date | None = None) -> DataFrame:
    """status equality and raw UTC date bounds, each optional (R2)."""
    if status:
        orders = orders.where(F.col("status") == status)
    pred = on_utc_days("order_date", start, end)
    return orders if pred is None else orders.where(pred)


def filter_customers(users: DataFrame, active: str | None) -> DataFrame:
    """F8: ``active`` / ``inactive`` / anything else = all."""
    if active == "active":
        return users.where(F.col("is_active"))
    if active == "inactive":
        return users.where(~F.col("is_active"))
    return users


def orders_of(orders: DataFrame, customer_ids: DataFrame) -> DataFrame:
    """orders of the given customers (``customer_ids`` has ``user_id``)."""
    return orders.join(customer_ids.select("user_id").distinct(), "user_id", "left_semi")


# --- joins -------------------------------------------------------------------

def item_counts(order_items: DataFrame) -> DataFrame:
    """Order lines per order (partial + final aggregate)."""
    return order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))


def order_item_counts(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Every order with its number of lines, 0 without lines."""
    return (orders.select("order_id", "user_name", "user_phone", "total_amount", "status", "order_date")
            .join(item_counts(order_items), "order_id", "left")
            .withColumn("item_count", F.coalesce("item_count", F.lit(0)).cast("long")))


LISTING_COLUMNS = ("order_id", "user_id", "user_name", "user_phone", "user_email", "total_amount",
                   "status", "order_date", "delivery_location")


def orders_with_payments(orders: DataFrame, order_items: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with line count and each distinct (payment status, mode) pair.

    One row per order and distinct pair (none -> one row with NULLs); the
    line count is not multiplied by repeated payments (fix).
    """
    pairs = payments.select("order_id", "payment_status", "payment_mode").distinct()
    return (orders.select(*LISTING_COLUMNS)
            .join(item_counts(order_items), "order_id", "left")
            .join(pairs, "order_id", "left")
            .withColumn("item_count", F.coalesce("item_count", F.lit(0)).cast("long")))


def orders_without_payment(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders that have no payment row."""
    return orders.join(payments.select("order_id"), "order_id", "left_anti")


PAYMENT_DETAIL_COLUMNS = ("payment_id", "payment_status", "payment_mode", "transaction_id", "payment_date",
                          "razorpay_order_id", "razorpay_payment_id", "razorpay_signature", "amount")


def order_payment_detail(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders left-joined to payments; payment columns replace same-named order columns."""
    pcols = [c for c in PAYMENT_DETAIL_COLUMNS if c in payments.columns]
    ocols = [c for c in orders.columns if c not in pcols]
    return orders.select(*ocols).join(payments.select("order_id", *pcols), "order_id", "left")


def order_lines_with_catalog(order_items: DataFrame, services: DataFrame, menu: DataFrame) -> DataFrame:
    """Order lines with their catalogue photo (service or menu by type):
    both catalogues as one table with its type, joined once."""
    photos = services.select(F.lit("service").alias("_type"), F.col("id").alias("_id"), F.col("photo").alias("_photo")).unionByName(
        menu.select(F.lit("menu").alias("_type"), F.col("id").alias("_id"), F.col("photo").alias("_photo")))
    own = F.when(F.col("item_type").isin("service", "menu"), F.col("_photo")).otherwise(F.col("item_photo"))
    return (order_items.join(photos, (F.col("item_type") == F.col("_type")) & (F.col("item_id") == F.col("_id")), "left")
            .withColumn("item_photo_catalog", own).drop("_type", "_id", "_photo"))


ADDRESS_COLUMNS = ("address_id", "full_name", "phone", "address_line1", "address_line2", "landmark", "city",
                   "state", "pincode", "latitude", "longitude", "is_default", "created_at")


def _address_order(addresses: DataFrame) -> list[Column]:
    keys = [pg_desc("is_default")]
    if "created_at" in addresses.columns:
        keys.append(pg_desc("created_at"))
    return keys + [pg_asc("address_id")]


def _addr(addresses: DataFrame, *extra: str) -> DataFrame:
    cols = [c for c in ADDRESS_COLUMNS + extra if c in addresses.columns]
    renamed = [F.col(c).alias({"full_name": "address_name", "phone": "address_phone"}.get(c, c)) for c in cols]
    return addresses.select(F.col("user_id").alias("_uid"), *renamed)


def customer_default_address(users: DataFrame, addresses: DataFrame) -> DataFrame:
    """J5 + W2: every customer with one default address (or NULLs).

    Several defaults: the newest (then lowest id) wins, chosen by a
    ``row_number() = 1`` group limit per customer before the join.
    """
    defaults = addresses.where(F.col("is_default"))
    w = Window.partitionBy("user_id").orderBy(*[k for k in _address_order(defaults)[1:]])
    one = defaults.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    a = _addr(one).drop("is_default")
    return users.join(a, users["id"] == a["_uid"], "left").drop("_uid")


def customer_addresses(users: DataFrame, addresses: DataFrame) -> DataFrame:
    """Every customer with each of its addresses, default first then newest;
    ``address_rank`` numbers them (NULL for a customer without addresses).

    Numbered over sorted ranges, so the addresses of one customer may be of any
    number."""
    ranked = numbered(in_ranges(addresses, "user_id", _address_order(addresses), "addresses"), "user_id", "address_rank")
    a = _addr(ranked, "address_rank")
    return users.select("id", "full_name").join(a, F.col("id") == F.col("_uid"), "left").drop("_uid")


def customer_rollup(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Every customer with order count and total spend (0 without orders).

    Orders are aggregated per customer first (map-side partial aggregate),
    so the join is one row per customer on each side.
    """
    per_user = orders.groupBy("user_id").agg(
        F.count("order_id").alias("total_orders"), F.sum("total_amount").alias("_spent"))
    return (users.join(per_user, users["id"] == per_user["user_id"], "left")
            .drop("user_id")
            .withColumn("total_orders", F.coalesce("total_orders", F.lit(0)).cast("long"))
            .withColumn("total_spent", F.coalesce(F.col("_spent"), F.lit(0).cast("decimal(28,2)")))
            .drop("_spent"))


# --- lists and pages -----------------------------------------------------------

#: Key lists of up to this many rows (a page number times its size) are broadcast.
BROADCAST_KEYS = 100_000


def only_keys(rows: DataFrame, keys: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` of the ``keys``, a list of at most ``most`` rows: broadcast
    while that bound is small, else a shuffle join."""
    return rows.join(F.broadcast(keys) if most <= BROADCAST_KEYS else keys, key, "left_semi")


def _first_orders(orders: DataFrame, sort: list[Column], k: int) -> DataFrame:
    """The first ``k`` orders by ``sort`` (dates and ids only): the top-k runs
    on these columns, and names join to the few that are left."""
    keys = orders.select("order_id", "order_date").orderBy(*sort).limit(k).select("order_id")
    return only_keys(orders, keys, "order_id", k)


def todays_orders(orders: DataFrame, order_items: DataFrame, as_of: date, k: int = 50) -> DataFrame:
    """The IST day's orders with line counts, newest first, ``k`` rows.

    The day's top ``k`` orders are taken first; only their lines are counted.
    """
    newest = order_desc("order_date", "order_id")
    first = _first_orders(orders.where(on_ist_days("order_date", as_of)), newest, k)
    lines = only_keys(order_items, first.select("order_id"), "order_id", k)
    return order_item_counts(first, lines).orderBy(*newest).limit(k)


def recent_activity(orders: DataFrame, k: int = 10) -> DataFrame:
    """Newest ``k`` orders with a badge; delivered falls to secondary here."""
    badge = F.lit("secondary")
    for s, b in reversed(list(ACTIVITY_BADGE.items())):
        badge = F.when(F.col("status") == s, F.lit(b)).otherwise(badge)
    newest = order_desc("order_date", "order_id")
    return (_first_orders(orders, newest, k).select("order_id", "user_name", "status", "order_date", badge.alias("status_badge"))
            .orderBy(*newest).limit(k))


def _check_page(page: int) -> int:
    if page < 1:
        raise ValueError("page must be >= 1")
    return (page - 1) * PAGE_SIZE


LISTING_ORDER = ("order_date", "order_id", "payment_status", "payment_mode")


def orders_listing(orders: DataFrame, order_items: DataFrame, payments: DataFrame, search: str | None = None,
                   status: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """O1 without paging (also the export K1): filters are applied to orders
    before the joins, so only matching orders reach the shuffle."""
    o = filter_orders(search_orders(orders, search), status, start, end)
    return orders_with_payments(o, order_items, payments)


def _listing_sort() -> list[Column]:
    return [pg_desc("order_date"), pg_asc("order_id"), pg_asc("payment_status"), pg_asc("payment_mode")]


def orders_page(orders: DataFrame, order_items: DataFrame, payments: DataFrame, page: int = 1, search: str | None = None,
                status: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """O1: page ``page`` (20 rows) of the listing, newest first.

    Every order gives at least one listing row and the order starts with
    (date, id), so the first ``offset + 20`` matching orders hold the page:
    they are taken first, and only their lines and payments are joined.
    """
    offset = _check_page(page)
    k = offset + PAGE_SIZE
    first = _first_orders(filter_orders(search_orders(orders, search), status, start, end), _listing_sort()[:2], k)
    keys = first.select("order_id")
    listing = orders_with_payments(first, only_keys(order_items, keys, "order_id", k), only_keys(payments, keys, "order_id", k))
    return listing.orderBy(*_listing_sort()).offset(offset).limit(PAGE_SIZE)


def page_counts(listing: DataFrame) -> DataFrame:
    """Total rows and pages ``ceil(total / 20)`` of a listing (one aggregate)."""
    n = F.count(F.lit(1))
    return listing.agg(n.alias("total_count"),
                       F.ceil(n / F.lit(PAGE_SIZE)).cast("long").alias("total_pages"))


def keyset_after(df: DataFrame, sort: list[tuple[str, bool]], cursor: tuple) -> DataFrame:
    """Rows strictly after ``cursor`` in the order ``sort`` ([(col, descending)]).

    Deep pages become ``keyset_after(...).orderBy(...).limit(20)``: a
    predicate plus a top-k, instead of sorting ``offset + 20`` rows.
    NULL keys follow PostgreSQL placement (first when descending).
    """
    pred = None
    eq_prefix = F.lit(True)
    for (name, desc_), value in zip(sort, cursor):
        c = F.col(name)
        if value is None:
            after = c.isNotNull() if desc_ else F.lit(False)
            same = c.isNull()
        else:
            after = (c < F.lit(value)) if desc_ else ((c > F.lit(value)) | c.isNull())
            same = c == F.lit(value)
        term = eq_prefix & after
        pred = term if pred is None else pred | term
        eq_prefix = eq_prefix & same
    return df.where(pred)


def customers_listing(users: DataFrame, orders: DataFrame, search: str | None = None) -> DataFrame:
    """O2 without paging (also the export K3): searched customers with rollup."""
    return customer_rollup(search_customers(users, search), orders)


CUSTOMER_SORTS = {
    "newest": lambda: [pg_desc("created_at"), pg_asc("id")],
    "oldest": lambda: [pg_asc("created_at"), pg_asc("id")],
    "most_orders": lambda: [pg_desc("total_orders"), pg_asc("id")],
    "most_spent": lambda: [pg_desc("total_spent"), pg_asc("id")],
}


def customers_sorted(listing: DataFrame, sort: str = "newest") -> DataFrame:
    """O3: customer listing in one of the four orders (unknown name -> newest)."""
    return listing.orderBy(*CUSTOMER_SORTS.get(sort, CUSTOMER_SORTS["newest"])())


def customers_page(users: DataFrame, orders: DataFrame, page: int = 1, sort: str = "newest",
                   search: str | None = None) -> DataFrame:
    """O2: page ``page`` of the customer listing, newest first by default.

    The date sorts need no order data: the first ``offset + 20`` customers are
    taken first, and only their orders are rolled up.
    """
    offset = _check_page(page)
    k = offset + PAGE_SIZE
    if sort not in ("most_orders", "most_spent"):
        users = search_customers(users, search).orderBy(*CUSTOMER_SORTS.get(sort, CUSTOMER_SORTS["newest"])()).limit(k)
        orders = only_keys(orders, users.select(F.col("id").alias("user_id")), "user_id", k)
        search = None
    return customers_sorted(customers_listing(users, orders, search), sort).offset(offset).limit(PAGE_SIZE)


def customer_recent_orders(orders: DataFrame, k: int = 5) -> DataFrame:
    """Newest ``k`` orders of every customer, with their rank."""
    w = Window.partitionBy("user_id").orderBy(*order_desc("order_date", "order_id"))
    return (orders.select("user_id", "order_id", "total_amount", "status", "order_date")
            .withColumn("recent_rank", F.row_number().over(w))
            .where(F.col("recent_rank") <= k))
