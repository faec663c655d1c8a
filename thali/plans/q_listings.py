"""Registered joins, searches, lists and pages with their DuckDB oracles."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from thali.operators import kpis, listings, pages, text_search
from thali.plans.registry import AS_OF, d, dbl, ist_day, register, sql, ts
from thali.session import shared_folder

# Fixed parameters of the registered listing queries.
ORDER_SEARCH = "USER12"          # case-insensitive, hits e-mails and ids
CUSTOMER_SEARCH = "er#0000001"  # hits names
DEEP_PAGE = 60
STATUS = "pending"
UTC_FROM, UTC_TO = date(1996, 1, 1), date(1998, 12, 31)
SEGMENT = "BUILDING"             # customers whose orders F9 lists

_ORDER_COLS = ("order_id, user_id, user_name, user_phone, user_email, total_amount, status, order_date, "
               "delivery_location")
_J2 = f"""
ic as (select order_id, count(*) item_count from f_order_items group by order_id),
pp as (select distinct order_id, payment_status, payment_mode from f_payments),
j2 as (
  select o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, o.total_amount, o.status,
    o.order_date, o.delivery_location, coalesce(ic.item_count, 0) item_count, pp.payment_status, pp.payment_mode
  from (select {_ORDER_COLS} from f_orders where {{cond}}) o
  left join ic on o.order_id = ic.order_id left join pp on o.order_id = pp.order_id)
"""
_LISTING_SORT = ("order_date desc nulls first, order_id asc nulls last, payment_status asc nulls last, "
                 "payment_mode asc nulls last")
_SEARCH = ("(user_name ilike '%{s}%' or user_phone ilike '%{s}%' or user_email ilike '%{s}%' "
           "or cast(order_id as varchar) ilike '%{s}%')").format(s=ORDER_SEARCH)
_FILTER = f"status = '{STATUS}' and order_date >= {ts(UTC_FROM)} and order_date < timestamp '1999-01-01 00:00:00'"


def _j2(cond: str = "true") -> str:
    return _J2.replace("{cond}", cond)


@register("order_item_counts", sql("orders", "order_items")("""
select o.order_id, o.user_name, o.user_phone, cast(o.total_amount as double) total_amount, o.status,
  o.order_date, coalesce(ic.n, 0) item_count
from f_orders o left join (select order_id, count(*) n from f_order_items group by order_id) ic
  on o.order_id = ic.order_id
"""))
def _j1(t):
    return listings.order_item_counts(t["orders"], t["order_items"])


@register("orders_with_payments", sql("orders", "order_items", "payments")("with " + _j2() + " select * replace (cast(total_amount as double) as total_amount) from j2"))
def _j2_all(t):
    return listings.orders_listing(t["orders"], t["order_items"], t["payments"])


@register("order_payment_detail", sql("orders", "payments")("""
select o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, cast(o.total_amount as double) total_amount, o.delivery_location,
  o.status, o.items, o.order_date, o.delivery_date, o.notes,
  p.payment_id, p.payment_status, p.payment_mode, p.transaction_id, p.payment_date, cast(p.amount as double) amount,
  p.razorpay_order_id, p.razorpay_payment_id, p.razorpay_signature
from f_orders o left join f_payments p on o.order_id = p.order_id
"""))
def _j3(t):
    return listings.order_payment_detail(t["orders"], t["payments"])


@register("order_lines_with_catalog", sql("order_items", "services", "menu")("""
with cat as (select 'service' kind, id, photo from f_services union all select 'menu', id, photo from f_menu)
select oi.*, coalesce(cat.photo, case when oi.item_type not in ('service', 'menu') then oi.item_photo end) item_photo_catalog
from (select * replace (cast(price as double) as price, cast(total as double) as total) from f_order_items) oi
left join cat on oi.item_type = cat.kind and oi.item_id = cat.id
"""))
def _j4(t):
    return listings.order_lines_with_catalog(t["order_items"], t["services"], t["menu"])


_ADDR_COLS = ("address_id, address_line1, address_line2, landmark, city, state, pincode, latitude, longitude")


@register("customer_default_address", sql("users", "addresses")(f"""
with a as (
  select * from (
    select *, row_number() over (partition by user_id order by address_id asc) rn
    from f_addresses where is_default) where rn = 1)
select u.*, {', '.join('a.' + c.strip() for c in _ADDR_COLS.split(','))}
from f_users u left join a on u.id = a.user_id
"""))
def _j5(t):
    return listings.customer_default_address(t["users"], t["addresses"])


@register("customer_addresses", sql("users", "addresses")(f"""
select u.id, u.full_name, {', '.join('a.' + c.strip() for c in _ADDR_COLS.split(','))}, a.is_default,
  row_number() over (partition by a.user_id order by a.is_default desc nulls first, a.address_id asc)
    * case when a.user_id is null then null else 1 end address_rank
from f_users u left join f_addresses a on u.id = a.user_id
"""))
def _j6(t):
    return listings.customer_addresses(t["users"], t["addresses"])


_J7 = """
j7 as (
  select u.*, coalesce(o.n, 0) total_orders, coalesce(o.spent, 0.0) total_spent
  from f_users u left join (
    select user_id, count(order_id) n, cast(sum(total_amount) as double) spent from f_orders group by user_id) o
  on u.id = o.user_id)
"""


@register("customer_orders_rollup", sql("users", "orders")("with " + _J7 + " select * from j7"))
def _j7(t):
    return listings.customer_rollup(t["users"], t["orders"])


@register("orders_without_payment", sql("orders", "payments")("""
select o.* replace (cast(total_amount as double) as total_amount) from f_orders o where not exists (select 1 from f_payments p where p.order_id = o.order_id)
"""))
def _j9(t):
    return listings.orders_without_payment(t["orders"], t["payments"])


@register("orders_search", sql("orders")(f"select * {dbl('total_amount')} from f_orders where {_SEARCH}"))
def _f1(t):
    return listings.search_orders(t["orders"], ORDER_SEARCH)


def _folder(t, name):
    """A folder of this run."""
    return f"{shared_folder(t.spark)}/thali/{uuid.uuid4().hex}/{name}"


@register("orders_search_indexed", sql("orders")(f"select * {dbl('total_amount')} from f_orders where {_SEARCH}"))
def _f1_indexed(t):
    index = text_search.TextIndex(t.spark, _folder(t, "order_texts"), "order_id").build(t["orders"], text_search.order_texts())
    return index.search(t["orders"], ORDER_SEARCH, listings.search_orders)


_CSEARCH = (f"(full_name ilike '%{CUSTOMER_SEARCH}%' or phone ilike '%{CUSTOMER_SEARCH}%' "
            f"or email ilike '%{CUSTOMER_SEARCH}%')")


@register("customers_search", sql("users")(f"select * from f_users where {_CSEARCH}"))
def _f2(t):
    return listings.search_customers(t["users"], CUSTOMER_SEARCH)


@register("customers_search_indexed", sql("users")(f"select * from f_users where {_CSEARCH}"))
def _f2_indexed(t):
    index = text_search.TextIndex(t.spark, _folder(t, "customer_texts"), "id").build(t["users"], text_search.customer_texts())
    return index.search(t["users"], CUSTOMER_SEARCH, listings.search_customers)


@register("orders_filter", sql("orders")(f"select * {dbl('total_amount')} from f_orders where {_FILTER}"))
def _f4(t):
    return listings.filter_orders(t["orders"], STATUS, UTC_FROM, UTC_TO)


@register("customers_active", sql("users")("select * from f_users where is_active"))
def _f8(t):
    return listings.filter_customers(t["users"], "active")


@register("customers_inactive", sql("users")("select * from f_users where not is_active"))
def _f8_inactive(t):
    return listings.filter_customers(t["users"], "inactive")


@register("customer_orders", sql("orders", "users")(f"""
select * {dbl('total_amount')} from f_orders where user_id in (select id from f_users where location = '{SEGMENT}')
"""))
def _f9(t):
    ids = t["users"].where(F.col("location") == SEGMENT).select(F.col("id").alias("user_id"))
    return listings.orders_of(t["orders"], ids)


@register("todays_orders", sql("orders", "order_items")(f"""
select o.order_id, o.user_name, o.user_phone, cast(o.total_amount as double) total_amount, o.status, o.order_date, coalesce(ic.n, 0) item_count
from f_orders o left join (select order_id, count(*) n from f_order_items group by order_id) ic
  on o.order_id = ic.order_id
where {ist_day('o.order_date')} = {d(AS_OF)}
order by o.order_date desc nulls first, o.order_id limit 50
"""))
def _t1(t):
    return listings.todays_orders(t.orders_between(AS_OF, AS_OF), t["order_items"], AS_OF)


@register("recent_activity", sql("orders")("""
select order_id, user_name, status, order_date,
  case when status = 'pending' then 'warning' when status = 'processing' then 'info'
       when status = 'completed' then 'success' when status = 'cancelled' then 'danger'
       else 'secondary' end status_badge
from f_orders order by order_date desc nulls first, order_id limit 10
"""))
def _t2(t):
    return listings.recent_activity(t["orders"])


@register("orders_page", sql("orders", "order_items", "payments")(
    "with " + _j2() + f" select * {dbl('total_amount')} from j2 order by {_LISTING_SORT} limit 20"))
def _o1(t):
    return listings.orders_page(t["orders"], t["order_items"], t["payments"], 1)


@register("orders_page_deep", sql("orders", "order_items", "payments")(
    "with " + _j2() + f" select * {dbl('total_amount')} from j2 order by {_LISTING_SORT} limit 20 offset {20 * (DEEP_PAGE - 1)}"))
def _o1_deep(t):
    listing = listings.orders_listing(t["orders"], t["order_items"], t["payments"])
    laid = pages.PagedListing(t.spark, _folder(t, "listing")).lay_out(listing, listings._listing_sort())
    return laid.page(DEEP_PAGE, listings._listing_sort())


@register("orders_page_filtered", sql("orders", "order_items", "payments")(
    "with " + _j2(_FILTER) + f" select * {dbl('total_amount')} from j2 order by {_LISTING_SORT} limit 20 offset 20"))
def _o1b(t):
    return listings.orders_page(t["orders"], t["order_items"], t["payments"], 2, status=STATUS, start=UTC_FROM, end=UTC_TO)


@register("orders_page_search", sql("orders", "order_items", "payments")(
    "with " + _j2(_SEARCH) + f" select * {dbl('total_amount')} from j2 order by {_LISTING_SORT} limit 20"))
def _o1c(t):
    return listings.orders_page(t["orders"], t["order_items"], t["payments"], 1, search=ORDER_SEARCH)


@register("orders_page_count", sql("orders", "order_items", "payments")(
    "with " + _j2(_FILTER) + " select count(*) total_count, cast(ceil(count(*) / 20) as bigint) total_pages from j2"))
def _o1d(t):
    listing = listings.orders_listing(t["orders"], t["order_items"], t["payments"],
                                      status=STATUS, start=UTC_FROM, end=UTC_TO)
    return listings.page_counts(listing)


@register("orders_page_revenue", sql("orders", "order_items", "payments")(
    "with " + _j2() + f", pg as (select * from j2 order by {_LISTING_SORT} limit 20) "
    "select cast(coalesce(sum(total_amount), 0) as double) page_revenue from pg"))
def _a15(t):
    return kpis.page_revenue(listings.orders_page(t["orders"], t["order_items"], t["payments"], 1))


@register("customers_page", sql("users", "orders")(
    "with " + _J7 + f" select * from j7 where {_CSEARCH} order by created_at desc nulls first, id limit 20"))
def _o2(t):
    return listings.customers_page(t["users"], t["orders"], 1, search=CUSTOMER_SEARCH)


@register("customers_sorted", sql("users", "orders")(
    "with " + _J7 + " select * from j7 order by total_spent desc nulls first, id limit 20 offset 40"))
def _o3(t):
    return listings.customers_page(t["users"], t["orders"], 3, "most_spent")


# the other three orders of the list, its second page
for _sort, _by in {"newest": "created_at desc nulls first", "oldest": "created_at asc nulls last", "most_orders": "total_orders desc nulls first"}.items():
    register(f"customers_{_sort}", sql("users", "orders")("with " + _J7 + f" select * from j7 order by {_by}, id limit 20 offset 20"))(
        lambda t, _sort=_sort: listings.customers_page(t["users"], t["orders"], 2, _sort))


@register("customer_recent_orders", sql("orders")("""
select * from (
  select user_id, order_id, cast(total_amount as double) total_amount, status, order_date,
    row_number() over (partition by user_id order by order_date desc nulls first, order_id) recent_rank
  from f_orders) where recent_rank <= 5
"""))
def _w1(t):
    return listings.customer_recent_orders(t["orders"])
