"""Batch forms of the streaming jobs (X1-X3), registered with oracles.

The same transform runs in ``thali.streaming.live``'s ``start_*`` jobs;
the tests check that the stream's final state equals these batch results.
"""

from __future__ import annotations

from thali.operators import changes
from thali.plans.q_changes import STATUS_BATCH_SQL, status_change_batch
from thali.plans.registry import register, sql
from thali.streaming import live


@register("live_counters", sql("orders")("""
select cast(order_date + interval 330 minute as date) "day", count(*) orders,
  cast(coalesce(sum(case when status <> 'cancelled' then total_amount end), 0) as double) revenue
from f_orders where order_date is not null group by 1
"""))
def _x1(t):
    return live.live_counters(t["orders"])


@register("live_counters_changed", sql("orders", "payments")(f"""
with {STATUS_BATCH_SQL},
now as (
  select o.order_date, o.total_amount, coalesce(l.ns, o.status) status from f_orders o left join last l on o.order_id = l.order_id)
select cast(order_date + interval 330 minute as date) "day", count(*) orders,
  cast(coalesce(sum(case when status <> 'cancelled' then total_amount end), 0) as double) revenue
from now where order_date is not null group by 1
"""))
def _x1_changed(t):
    """The counters after a batch of status changes, by signed changes alone."""
    history = changes.apply_status_changes(t["orders"], status_change_batch(t)).history
    return live.day_totals(live.day_deltas(live.order_feed(t["orders"], history)))


@register("update_counts", """
with first as (select event_id, min(ts) ts from events where event_type = 'purchase' and ts is not null group by event_id)
select timestamp '1970-01-01 00:00:00' + to_seconds(cast(floor(epoch(ts) / 30) * 30 as bigint)) window_start,
  count(*) new_orders
from first group by 1
""")
def _x2(t):
    return live.update_counts(t.raw("events"))


@register("map_view_counts", sql("addresses")("""
with a as (select user_id, latitude, longitude from f_addresses where is_default)
select date_trunc('hour', e.ts) hour_start, a.latitude, a.longitude, count(*) views
from events e join a on e.user_id = a.user_id
where e.event_type = 'view' group by 1, 2, 3
"""))
def _x3(t):
    return live.map_view_counts(live.map_view_events(t.raw("events"), t["addresses"]))
