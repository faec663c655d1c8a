"""Registered documents, changes, exports and the table report.

Change batches are derived from the tables themselves by business rules, so
their size grows with the data:

* status changes: pending orders placed before 1998 are cancelled (seq 1,
  with a note); every order with a refunded payment asks for the invalid
  status ``refunded`` (seq 2, rejected); every order with a completed payment
  is marked completed (seq 3, no note, so the seq-1 note stays); every hundredth
  order's negative id is completed (seq 4): no such order exists.
* stored changes: one month's pending orders are cancelled, its delivered orders
  paid, its cancelled orders deleted, in tables kept by parts.
* payment changes: delivered orders are paid at their delivery time with a
  transaction id (seq 1); cancelled orders get payment status ``cancelled``
  and an empty transaction id (seq 2).
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from thali.functions.temporal import ntz
from thali.operators import changes, documents
from thali.plans import q_kpis  # noqa: F401  its oracles are used below
from thali.plans.registry import AS_OF, REGISTRY, dbl, register, sql, ts
from thali.session import shared_folder
from thali.sinks import exports
from thali.sinks.versions import PartedTable, hash_part, month_part

# The month that the stored changes touch; parts of the payments.
MONTH_START, MONTH_END = date(1997, 3, 1), date(1997, 4, 1)
PAYMENT_PARTS = 32


def status_change_batch(t):
    o, p = t["orders"], t["payments"]
    text, no_text = F.lit("auto-cancel"), F.lit(None).cast("string")

    def change(when, order_id, status, notes, seq):
        return F.when(when, F.struct(order_id.alias("order_id"), F.lit(status).alias("new_status"), notes.alias("notes"),
                                     F.lit("rules").alias("changed_by"), F.lit(seq).cast("long").alias("seq")))

    key = F.col("order_id")
    early = (F.col("status") == "pending") & (F.col("order_date") < F.lit("1998-01-01").cast("timestamp_ntz"))
    asks = F.array(change(early, key, "cancelled", text, 1), change(key % 100 == 0, -key, "completed", no_text, 4))
    own = o.select(F.inline(F.filter(asks, lambda c: c.isNotNull())))
    asked = p.where(F.col("payment_status").isin("refunded", "completed")).select("order_id", "payment_status").distinct()
    paid = asked.select("order_id", F.col("payment_status").alias("new_status"), F.lit(None).cast("string").alias("notes"),
                        F.lit("rules").alias("changed_by"),
                        F.when(F.col("payment_status") == "refunded", 2).otherwise(3).cast("long").alias("seq"))
    return own.unionByName(paid)


STATUS_BATCH_SQL = """
batch as (
  select order_id, 'cancelled' new_status, 'auto-cancel' notes, 'rules' changed_by, 1 seq from f_orders
  where status = 'pending' and order_date < timestamp '1998-01-01 00:00:00'
  union all
  select distinct order_id, 'refunded', null, 'rules', 2 from f_payments where payment_status = 'refunded'
  union all
  select distinct order_id, 'completed', null, 'rules', 3 from f_payments where payment_status = 'completed'
  union all
  select -order_id, 'completed', null, 'rules', 4 from f_orders where order_id % 100 = 0),
valid as (
  select * from batch where new_status in ('pending', 'processing', 'completed', 'cancelled', 'delivered')
    and order_id in (select order_id from f_orders)),
last as (
  select order_id, arg_max(new_status, seq) ns, arg_max(notes, seq) filter (where notes is not null) nn,
    count(notes) has_notes
  from valid group by order_id)
"""


@register("apply_status_changes", sql("orders", "payments")(f"""
with {STATUS_BATCH_SQL}
select o.* replace (cast(o.total_amount as double) as total_amount,
                    coalesce(l.ns, o.status) as status,
                    case when l.has_notes > 0 then l.nn else o.notes end as notes)
from f_orders o left join last l on o.order_id = l.order_id
"""))
def _c1(t):
    return changes.apply_status_changes(t["orders"], status_change_batch(t)).snapshot


@register("status_history", sql("orders", "payments")(f"""
with {STATUS_BATCH_SQL}
select v.order_id, v.seq, coalesce(lag(v.new_status) over (partition by v.order_id order by v.seq), o.status) old_status,
  v.new_status, v.changed_by, v.notes
from valid v join f_orders o on v.order_id = o.order_id
"""))
def _c1h(t):
    return changes.apply_status_changes(t["orders"], status_change_batch(t)).history


@register("status_rejects", sql("orders", "payments")(f"""
with {STATUS_BATCH_SQL}
select *, case when order_id not in (select order_id from f_orders) then 'unknown_order'
               else 'invalid_status' end reason
from batch where new_status not in ('pending', 'processing', 'completed', 'cancelled', 'delivered')
   or order_id not in (select order_id from f_orders)
"""))
def _c1r(t):
    return changes.apply_status_changes(t["orders"], status_change_batch(t)).rejects


def payment_change_batch(t):
    paid = F.col("status") == "delivered"
    return t["orders"].where(F.col("status").isin("delivered", "cancelled")).select(
        "order_id", F.when(paid, F.lit("completed")).otherwise(F.lit("cancelled")).alias("payment_status"),
        F.when(paid, F.concat(F.lit("TXN"), F.col("order_id").cast("string"))).otherwise(F.lit("")).alias("transaction_id"),
        F.when(paid, F.col("delivery_date")).otherwise(F.col("order_date")).alias("changed_at"),
        F.when(paid, 1).otherwise(2).cast("long").alias("seq"))


@register("apply_payment_changes", sql("orders", "payments")("""
with batch as (
  select order_id, 'completed' payment_status, 'TXN' || cast(order_id as varchar) transaction_id,
    delivery_date changed_at, 1 seq from f_orders where status = 'delivered'
  union all
  select order_id, 'cancelled', '', order_date, 2 from f_orders where status = 'cancelled'),
per as (
  select order_id, arg_max(payment_status, seq) st,
    arg_max(transaction_id, seq) filter (where transaction_id <> '') tx,
    arg_min(transaction_id, seq) first_tx,
    arg_max(changed_at, seq) filter (where payment_status = 'completed') paid_at,
    min(seq) first_seq
  from batch group by order_id),
per2 as (
  select p.*, (select arg_max(b.changed_at, b.seq) from batch b
               where b.order_id = p.order_id and b.payment_status = 'completed' and b.seq > p.first_seq) paid_after
  from per p)
select y.payment_id, y.order_id, y.user_id, cast(y.amount as double) amount, y.payment_mode,
  coalesce(per2.st, y.payment_status) payment_status, coalesce(per2.tx, y.transaction_id) transaction_id,
  coalesce(per2.paid_at, y.payment_date) payment_date, y.razorpay_order_id, y.razorpay_payment_id, y.razorpay_signature
from f_payments y left join per2 on y.order_id = per2.order_id
union all
select (select max(payment_id) from f_payments) + o.order_id, o.order_id, o.user_id, cast(o.total_amount as double), o.payment_mode, per2.st,
  coalesce(per2.tx, per2.first_tx), per2.paid_after, null, null, null
from per2 join f_orders o on o.order_id = per2.order_id
where per2.order_id not in (select order_id from f_payments)
"""))
def _c2(t):
    return changes.apply_payment_changes(t["payments"], t["orders"], payment_change_batch(t)).snapshot


@register("bulk_status_update", sql("orders")(f"""
select o.* replace (cast(o.total_amount as double) as total_amount,
  case when o.status = 'processing' then 'delivered' else o.status end as status)
from f_orders o
"""))
def _c3(t):
    ids = t["orders"].where(F.col("status") == "processing").select("order_id")
    return changes.apply_status_changes(t["orders"], changes.bulk_status_changes(ids, "delivered")).snapshot


@register("bulk_delete_orders_orders", sql("orders")(f"select * {dbl('total_amount')} from f_orders where status <> 'cancelled'"))
def _c4_orders(t):
    return _c4_tables(t)[0]


@register("bulk_delete_orders_payments", sql("orders", "payments")(f"""
select * {dbl('amount')} from f_payments where order_id not in (select order_id from f_orders where status = 'cancelled')
"""))
def _c4_payments(t):
    return _c4_tables(t)[2]


def _c4_tables(t):
    ids = t["orders"].where(F.col("status") == "cancelled").select("order_id")
    return changes.bulk_delete_orders(t["orders"], t["order_items"], t["payments"], ids)


@register("bulk_delete_orders", sql("orders", "order_items")(f"""
select * {dbl('price', 'total')} from f_order_items
where order_id not in (select order_id from f_orders where status = 'cancelled')
"""))
def _c4(t):
    return _c4_tables(t)[1]


def _stored(t, name, table, column, part):
    """A table kept in parts, in a folder of this run."""
    made = PartedTable(t.spark, f"{shared_folder(t.spark)}/thali/{uuid.uuid4().hex}/{name}", column, part)
    made.create(t[table])
    return made


def _of_month(t):
    return t["orders"].where((F.col("order_date") >= ntz(MONTH_START)) & (F.col("order_date") < ntz(MONTH_END)))


_IN_MONTH = f"order_date >= {ts(MONTH_START)} and order_date < {ts(MONTH_END)}"


@register("status_changes_stored", sql("orders")(f"""
select * replace (cast(total_amount as double) as total_amount,
  case when status = 'pending' and {_IN_MONTH} then 'cancelled' else status end as status,
  case when status = 'pending' and {_IN_MONTH} then 'month closed' else notes end as notes)
from f_orders
"""))
def _c1_stored(t):
    """C1 on orders kept by month: one month's pending orders are cancelled."""
    table = _stored(t, "orders", "orders", "order_date", month_part)
    late = _of_month(t).where(F.col("status") == "pending")
    batch = late.select("order_id", "order_date", F.lit("cancelled").alias("new_status"), F.lit("month closed").alias("notes"),
                        F.lit("rules").alias("changed_by"), F.lit(1).cast("long").alias("seq"))
    table.update(batch, "order_id", lambda rows: changes.apply_status_changes(rows, batch.drop("order_date")).snapshot)
    return table.read().drop("part")


@register("payment_changes_stored", sql("orders", "payments")(f"""
with batch as (select order_id, user_id, total_amount, payment_mode, delivery_date from f_orders where status = 'delivered' and {_IN_MONTH})
select y.payment_id, y.order_id, y.user_id, cast(y.amount as double) amount, y.payment_mode,
  case when b.order_id is not null then 'completed' else y.payment_status end payment_status,
  case when b.order_id is not null then 'TXN' || cast(y.order_id as varchar) else y.transaction_id end transaction_id,
  coalesce(b.delivery_date, y.payment_date) payment_date, y.razorpay_order_id, y.razorpay_payment_id, y.razorpay_signature
from f_payments y left join batch b on y.order_id = b.order_id
union all
select (select max(payment_id) from f_payments) + order_id, order_id, user_id, cast(total_amount as double), payment_mode, 'completed',
  'TXN' || cast(order_id as varchar), null, null, null, null
from batch where order_id not in (select order_id from f_payments)
"""))
def _c2_stored(t):
    """C2 on payments kept by a hash of the order: one month's delivered orders
    are paid."""
    table = _stored(t, "payments", "payments", "order_id", hash_part(PAYMENT_PARTS))
    batch = payment_change_batch({"orders": _of_month(t).where(F.col("status") == "delivered")})
    whole = table.read().drop("part")
    table.update(batch, "order_id", lambda rows: changes.apply_payment_changes(rows, t["orders"], batch, whole).snapshot, create=True)
    return table.read().drop("part")


@register("bulk_delete_stored", sql("orders")(f"""
select * {dbl('total_amount')} from f_orders where not coalesce(status = 'cancelled' and {_IN_MONTH}, false)
"""))
def _c4_stored(t):
    """C4 on orders kept by month: one month's cancelled orders are deleted."""
    table = _stored(t, "orders", "orders", "order_date", month_part)
    ids = _of_month(t).where(F.col("status") == "cancelled").select("order_id")
    table.update(ids, "order_id", lambda rows: rows.join(ids, "order_id", "left_anti"))
    return table.read().drop("part")


_LINK = ("case when {p}latitude is not null and {p}longitude is not null then 'https://www.google.com/maps?q=' "
         "|| cast({p}latitude as varchar) || ',' || cast({p}longitude as varchar) || '&z=15' end")
_IST = "case when {x} is not null then strftime({x} + interval 330 minute, '%d %b %Y, %I:%M %p') end"
_MONEY = "case when {x} is null then '₹0.00' else '₹' || format('{{:,.2f}}', {x}) end"
_ADDRESS = documents.ADDRESS_FIELDS
_HEADER_SQL = f"""
header as (
  select o.* replace (cast(o.total_amount as double) as total_amount),
    {_IST.format(x='o.order_date')} order_date_formatted, {_IST.format(x='o.delivery_date')} delivery_date_formatted,
    {_MONEY.format(x='o.total_amount')} total_amount_formatted,
    u.full_name customer_full_name, u.phone customer_phone, u.email customer_email,
    {', '.join(f'a.{c} customer_{c}' for c in _ADDRESS)}, {_LINK.format(p='a.')} customer_map_link
  from f_orders o left join f_users u on o.user_id = u.id
  left join (select * from (select *, row_number() over (partition by user_id order by address_id) rn
                            from f_addresses where is_default) where rn = 1) a on a.user_id = u.id)
"""
_LINE_SQL = f"""
line as (
  select oi.* replace (cast(oi.price as double) as price, cast(oi.total as double) as total,
      case when coalesce(oi.item_photo, '') = '' and coalesce(c.photo, '') <> '' then c.photo else oi.item_photo end as item_photo),
    {_MONEY.format(x='oi.price')} price_formatted, {_MONEY.format(x='oi.total')} total_formatted
  from f_order_items oi left join (
    select 'service' kind, id, photo from f_services union all select 'menu', id, photo from f_menu) c
  on oi.item_type = c.kind and oi.item_id = c.id)
"""
_PAYMENT_SQL = f"""
payment as (
  select order_id, payment_id, payment_status, payment_mode, transaction_id, payment_date, razorpay_order_id, razorpay_payment_id,
    razorpay_signature, cast(amount as double) amount, {_IST.format(x='payment_date')} payment_date_formatted
  from f_payments)
"""
_ORDER_TABLES = ("orders", "users", "addresses", "order_items", "services", "menu", "payments")


def _order_documents(t):
    return documents.order_documents(*(t[x] for x in ("orders", "order_items", "payments", "users", "addresses", "services", "menu")))


@register("order_documents", sql(*_ORDER_TABLES)(f"""
with {_HEADER_SQL}, {_LINE_SQL}, {_PAYMENT_SQL}
select *, 'header' section from header
union all by name select *, 'line' section from line
union all by name select *, 'payment' section from payment
"""))
def _n1(t):
    return _order_documents(t)


@register("order_documents_items", sql(*_ORDER_TABLES)(f"with {_LINE_SQL} select order_id, line_no, item_type, item_id, total, item_photo from line"))
def _n1_lines(t):
    return _order_documents(t).where("section = 'line'").select("order_id", "line_no", "item_type", "item_id", "total", "item_photo")


@register("customer_documents", sql("users", "addresses", "orders")(f"""
with recent as (
  select user_id, cast(row_number() over (partition by user_id order by order_date desc nulls first, order_id) as integer) recent_rank,
    order_id, cast(total_amount as double) total_amount, status, order_date
  from f_orders),
header as (
  select u.* exclude (id), u.id user_id, (select count(*) from f_orders o where o.user_id = u.id) total_orders,
    {_IST.format(x='u.created_at')} created_at_formatted, {_IST.format(x='u.last_login')} last_login_formatted
  from f_users u),
address as (
  select user_id, address_id, is_default, {', '.join(_ADDRESS)}, {_LINK.format(p='')} map_link, not coalesce(is_default, false) not_default
  from f_addresses),
per_status as (
  select user_id, status, count(*) orders, cast(sum(total_amount) as double) total_amount from f_orders group by user_id, status)
select *, 'header' section from header
union all by name select *, 'address' section from address
union all by name select *, 'status' section from per_status
union all by name select *, 'recent' section from recent where recent_rank <= 5
"""))
def _n2(t):
    return documents.customer_documents(t["users"], t["addresses"], t["orders"])


@register("chart_series", sql("orders", "order_items", "payments")(f"""
with days as (
  select cast(order_date + interval 330 minute as date) d, count(*) n, cast(coalesce(sum(total_amount), 0) as double) revenue
  from f_orders where order_date >= timestamp '{AS_OF - timedelta(days=30)} 00:00:00' group by 1),
items as (
  select item_name, sum(quantity) n from f_order_items group by item_name order by n desc nulls first, item_name limit 10),
modes as (
  select coalesce(payment_mode, 'Unknown') label, count(*) n, cast(sum(amount) as double) amount
  from f_payments where payment_status = 'completed' group by payment_mode)
select 'daily_orders' chart, cast(d - date '1970-01-01' as double) place, strftime(d, '%b %d') "label", cast(n as double) "value",
  revenue value2, cast(null as varchar) color from days
union all select 'status_distribution', 0.0, upper(left(status, 1)) || lower(substr(status, 2)), count(*), null,
  case status when 'pending' then '#ffc107' when 'processing' then '#17a2b8' when 'completed' then '#28a745'
    when 'cancelled' then '#dc3545' when 'delivered' then '#20c997' else '#6c757d' end from f_orders group by status
union all select 'top_items', -cast(n as double), item_name, n, null, null from items
union all select 'payment_methods', -amount, label, n, amount, null from modes
"""))
def _n3(t):
    return documents.chart_series(t["orders"], t["order_items"], t["payments"], AS_OF)


@register("export_orders", sql("orders", "order_items", "payments")("""
with ic as (select order_id, count(*) item_count from f_order_items group by order_id),
pp as (select distinct order_id, payment_status, payment_mode from f_payments)
select o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, cast(o.total_amount as double) total_amount,
  o.status, o.order_date, o.delivery_location, coalesce(ic.item_count, 0) item_count, pp.payment_status, pp.payment_mode
from f_orders o left join ic on o.order_id = ic.order_id left join pp on o.order_id = pp.order_id
where o.status = 'delivered'
"""))
def _k1(t):
    return exports.export_orders_frame(t["orders"], t["order_items"], t["payments"], status="delivered")


@register("export_selected_orders", sql("orders", "payments")(f"""
select * {dbl('total_amount')} from f_orders where order_id in (select order_id from f_payments where payment_status = 'failed')
"""))
def _k2(t):
    ids = t["payments"].where(F.col("payment_status") == "failed").select("order_id")
    return exports.export_selected_frame(t["orders"], ids)


@register("export_customers", sql("users", "orders")("""
select u.*, coalesce(o.n, 0) total_orders, coalesce(o.spent, 0.0) total_spent
from f_users u left join (
  select user_id, count(order_id) n, cast(sum(total_amount) as double) spent from f_orders group by user_id) o
on u.id = o.user_id
"""))
def _k3(t):
    return exports.export_customers_frame(t["users"], t["orders"])


@register("export_statistics", sql("order_items")("""
select item_type category, count(*) order_count, cast(sum(total) as double) total_revenue
from f_order_items group by item_type
"""))
def _k4(t):
    return _k4_section(t, "categories")


def _k4_section(t, name):
    return exports.statistics_sections(t["orders"], t["order_items"], t["payments"], "month", AS_OF)[name]


@register("export_statistics_kpis", REGISTRY["period_kpis_month"].oracle)
def _k4_kpis(t):
    return _k4_section(t, "kpis")


@register("export_statistics_daily", REGISTRY["daily_sales"].oracle)
def _k4_daily(t):
    return _k4_section(t, "daily")


@register("export_statistics_payments", REGISTRY["payment_methods"].oracle)
def _k4_payments(t):
    return _k4_section(t, "payment_methods")


@register("activity_log", sql("orders")("""
select cast(null as integer) user_id, 'payment_update' activity_type,
  'Payment for order ' || cast(order_id as varchar) || ' updated to ' ||
  case when status = 'delivered' then 'completed' else 'cancelled' end description,
  cast(null as varchar) ip_address, cast(null as varchar) user_agent,
  case when status = 'delivered' then delivery_date else order_date end created_at
from f_orders where status in ('delivered', 'cancelled')
"""))
def _k5(t):
    return changes.apply_payment_changes(t["payments"], t["orders"], payment_change_batch(t)).history
