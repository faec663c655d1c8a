"""Registered KPI and report queries (A1-A18) with their DuckDB oracles."""

from __future__ import annotations

from datetime import timedelta

from thali.functions.temporal import check_range, period_days
from thali.operators import day_states, kpis
from thali.operators.listings import customer_rollup
from thali.plans.registry import AS_OF, RANGE_END, RANGE_START, d, ist_day, register, sql, ts
from thali.session import stored

_TODAY = f"{ist_day('order_date')} = {d(AS_OF)}"
_PERIODS = {
    "all": "true",
    "today": _TODAY,
    "week": f"order_date >= {ts(AS_OF - timedelta(days=7))}",
    "month": f"order_date >= {ts(AS_OF - timedelta(days=30))}",
    "custom": f"{ist_day('order_date')} between {d(RANGE_START)} and {d(RANGE_END)}",
}


def _kpi_sql(cond: str) -> str:
    return sql("orders")(f"""
select count(*) total_orders,
  cast(coalesce(sum(case when status <> 'cancelled' then total_amount else 0 end), 0) as double) total_revenue,
  count(distinct user_id) total_customers,
  coalesce(cast(sum(case when status <> 'cancelled' then total_amount end) as double)
           / nullif(count(case when status <> 'cancelled' then total_amount end), 0), 0) avg_order_value,
  count(case when status = 'pending' then 1 end) pending_orders,
  count(case when status in ('completed', 'delivered') then 1 end) completed_orders,
  count(case when status = 'cancelled' then 1 end) cancelled_orders,
  (select count(*) from f_orders where {_TODAY}) today_orders,
  (select cast(coalesce(sum(case when status <> 'cancelled' then total_amount else 0 end), 0) as double)
     from f_orders where {_TODAY}) today_revenue
from f_orders where {cond}
""")


def _kpis(t, period):
    lo, hi = check_range(RANGE_START.isoformat(), RANGE_END.isoformat())
    days = period_days(period, AS_OF, lo, hi)
    orders = t.orders_between(*days) if days else t["orders"]
    return kpis.period_kpis(orders, period, AS_OF, lo, hi)


for _p, _cond in _PERIODS.items():
    register("period_kpis" if _p == "all" else f"period_kpis_{_p}", _kpi_sql(_cond))(
        lambda t, _p=_p: _kpis(t, _p))


def _states(t):
    """The daily states as the stored tables that reports read."""
    return stored(day_states.day_sums(t["orders"]), "day_sums"), stored(day_states.day_customers(t["orders"]), "day_customers")


for _p, _cond in _PERIODS.items():
    register("period_kpis_by_days" if _p == "all" else f"period_kpis_by_days_{_p}", _kpi_sql(_cond))(
        lambda t, _p=_p: day_states.period_kpis(*_states(t), _p, AS_OF, RANGE_START, RANGE_END))


@register("header_counters", sql("orders")(f"""
select count(case when {_TODAY} then 1 end) today_orders,
  count(case when status = 'pending' then 1 end) pending_orders,
  cast(coalesce(sum(case when {_TODAY} and status <> 'cancelled' then total_amount end), 0) as double) today_revenue
from f_orders
"""))
def _header(t):
    return kpis.header_counters(t["orders"], AS_OF)


@register("header_counters_by_days", sql("orders")(f"""
select count(case when {_TODAY} then 1 end) today_orders,
  count(case when status = 'pending' then 1 end) pending_orders,
  cast(coalesce(sum(case when {_TODAY} and status <> 'cancelled' then total_amount end), 0) as double) today_revenue
from f_orders
"""))
def _header_by_days(t):
    return day_states.header_counters(stored(day_states.day_sums(t["orders"]), "day_sums"), AS_OF)


@register("status_distribution", sql("orders")("""
select status, count(*) "count",
  ((count(*) * 2000 + (select count(*) from f_orders)) // (2 * (select count(*) from f_orders))) / 10.0 percentage
from f_orders group by status
"""))
def _status_distribution(t):
    return kpis.status_distribution(t["orders"])


@register("status_counts", sql("orders")("""
select status, count(*) "count" from f_orders group by status
"""))
def _status_counts(t):
    return kpis.status_counts(t["orders"])


@register("status_count_row", sql("orders")("""
select count(*) filter (status = 'pending') pending, count(*) filter (status = 'processing') processing,
  count(*) filter (status = 'completed') completed, count(*) filter (status = 'cancelled') cancelled,
  count(*) filter (status = 'delivered') delivered, count(*) "all" from f_orders
"""))
def _status_count_row(t):
    return kpis.status_count_row(t["orders"])


@register("top_items", sql("order_items")("""
select item_name, item_type, sum(quantity) total_quantity, cast(sum(total) as double) total_revenue
from f_order_items group by item_name, item_type
order by total_quantity desc nulls first, item_name asc nulls last, item_type asc nulls last
limit 10
"""))
def _top_items(t):
    return kpis.top_items(t["order_items"], 10)


def _daily_sql(cond: str, extra: bool = False) -> str:
    cols = ("count(*) order_count, cast(coalesce(sum(total_amount), 0) as double) total_revenue, "
            "strftime(" + ist_day("order_date") + ", '%b %d') label")
    if extra:
        cols = ("count(*) order_count, cast(coalesce(sum(total_amount), 0) as double) total_revenue, "
                "coalesce(cast(coalesce(sum(total_amount), 0) as double) / nullif(count(*), 0), 0) avg_order, "
                "count(distinct user_id) customers")
    return sql("orders")(f"""
select {ist_day('order_date')} date, {cols}
from f_orders where {cond} group by {ist_day('order_date')}
""")


register("daily_breakdown_by_days", _daily_sql(_PERIODS["custom"], extra=True))(
    lambda t: day_states.daily_breakdown(*_states(t), RANGE_START, RANGE_END))
register("daily_sales_custom", _daily_sql(_PERIODS["custom"]))(
    lambda t: kpis.daily_sales(t.orders_between(RANGE_START, RANGE_END), start=RANGE_START, end=RANGE_END))
register("daily_sales_week", _daily_sql(_PERIODS["week"]))(
    lambda t: kpis.daily_sales(t["orders"], days=7, as_of=AS_OF))
register("daily_sales", _daily_sql(_PERIODS["month"]))(
    lambda t: kpis.daily_sales(t["orders"], days=30, as_of=AS_OF))
register("daily_breakdown", _daily_sql(_PERIODS["custom"], extra=True))(
    lambda t: kpis.daily_breakdown(t.orders_between(RANGE_START, RANGE_END), start=RANGE_START, end=RANGE_END))


@register("category_sales", sql("order_items")("""
select item_type category, count(*) order_count, cast(sum(total) as double) total_revenue
from f_order_items group by item_type
"""))
def _category_sales(t):
    return kpis.category_sales(t["order_items"])


@register("payment_methods", sql("payments")("""
with done as (select * from f_payments where payment_status = 'completed')
select coalesce(payment_mode, 'Unknown') method, count(*) order_count, cast(sum(amount) as double) total_amount,
  (count(*) * 200 + (select count(*) from done)) // (2 * (select count(*) from done)) share
from done group by payment_mode
"""))
def _payment_methods(t):
    return kpis.payment_methods(t["payments"])


@register("top_items_chart", sql("order_items")("""
select item_name, sum(quantity) total_quantity from f_order_items group by item_name
order by total_quantity desc nulls first, item_name asc nulls last limit 10
"""))
def _top_items_chart(t):
    return kpis.top_items_by_name(t["order_items"], 10)


@register("customer_status_summary", sql("orders")("""
select user_id, status, count(*) "count", cast(sum(total_amount) as double) total_amount
from f_orders group by user_id, status
"""))
def _customer_status_summary(t):
    return kpis.customer_status_summary(t["orders"])


_PCT = "case when t > 0 then ((n * 2000 + t) // (2 * t)) / 10.0 else 0.0 end"


@register("order_status_summary", sql("orders")(f"""
with k as (
  select count(*) t,
    count(case when status = 'pending' then 1 end) pe,
    count(case when status in ('completed', 'delivered') then 1 end) co,
    count(case when status = 'cancelled' then 1 end) ca
  from f_orders where {_PERIODS['month']}),
p as (
  select 'pending' part, pe n, t, co from k union all
  select 'processing', t - pe - co - ca, t, co from k union all
  select 'completed', co, t, co from k union all
  select 'cancelled', ca, t, co from k)
select part, n orders, {_PCT} percentage,
  case when t > 0 then ((co * 2000 + t) // (2 * t)) / 10.0 else 0.0 end completion_rate
from p
union all
select 'total', t, case when t > 0 then 100.0 else 0.0 end,
  case when t > 0 then ((co * 2000 + t) // (2 * t)) / 10.0 else 0.0 end from k
"""))
def _order_status_summary(t):
    return kpis.status_summary(kpis.period_kpis(t["orders"], "month", AS_OF))


@register("revenue_summary", sql("orders")(f"""
with k as (
  select cast(coalesce(sum(case when status <> 'cancelled' then total_amount else 0 end), 0) as double) rev,
    count(distinct user_id) cust,
    coalesce(cast(sum(case when status <> 'cancelled' then total_amount end) as double)
             / nullif(count(case when status <> 'cancelled' then total_amount end), 0), 0) aov,
    (select cast(coalesce(sum(case when status <> 'cancelled' then total_amount else 0 end), 0) as double)
       from f_orders where {_TODAY}) today_rev
  from f_orders where {_PERIODS['week']}),
m as (
  select 'total_revenue' metric, rev value from k union all
  select 'today_revenue', today_rev from k union all
  select 'avg_order_value', aov from k union all
  select 'total_customers', cast(cust as double) from k union all
  select 'lifetime_value', coalesce(rev / nullif(cust, 0), 0) from k)
select metric, value,
  case when metric = 'total_customers' then cast(cast(value as bigint) as varchar)
       else '₹' || replace(format('{{:,.2f}}', value), ',', '') end text
from m
"""))
def _revenue_summary(t):
    return kpis.revenue_summary(kpis.period_kpis(t["orders"], "week", AS_OF))


@register("customer_base_stats", sql("users", "orders")("""
with r as (
  select u.id, u.is_active, u.last_login, coalesce(o.n, 0) order_count, coalesce(o.spent, 0) total_spent
  from f_users u left join (
    select user_id, count(*) n, sum(total_amount) spent from f_orders group by user_id) o
  on u.id = o.user_id)
select count(*) total_customers,
  count(case when is_active then 1 end) active_customers,
  count(last_login) recently_active,
  count(case when order_count > 0 then 1 end) with_orders,
  count(case when order_count > 5 then 1 end) frequent_customers,
  cast(coalesce(sum(total_spent), 0) as double) total_spent,
  cast(coalesce(max(total_spent), 0) as double) top_spend
from r
"""))
def _customer_base_stats(t):
    return kpis.customer_base_stats(customer_rollup(t["users"], t["orders"]))


@register("hourly_orders", sql("orders")("""
with h as (select range "hour" from range(24)),
c as (select hour(order_date + interval 330 minute) "hour", count(*) n from f_orders
      where order_date is not null group by 1)
select cast(h."hour" as integer) "hour", coalesce(c.n, 0) orders from h left join c on h."hour" = c."hour"
"""))
def _hourly(t):
    return kpis.hourly_orders(t["orders"])


@register("customer_acquisition", sql("orders")("""
with o as (select distinct user_id, date_trunc('month', order_date + interval 330 minute) m
           from f_orders where order_date is not null and user_id is not null),
f as (select user_id, min(m) first_m from o group by user_id)
select cast(o.m as date) "month",
  count(case when o.m = f.first_m then 1 end) new_customers,
  count(case when o.m > f.first_m then 1 end) repeat_customers,
  strftime(o.m, '%b %Y') label
from o join f on o.user_id = f.user_id group by o.m
"""))
def _acquisition(t):
    return kpis.customer_acquisition(t["orders"])


@register("dashboard_delivered", sql("orders")("""
select count(case when status = 'delivered' then 1 end) delivered_orders from f_orders
"""))
def _delivered(t):
    return kpis.delivered_count(t["orders"])
