"""Registered catalogue, display and location queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from thali.operators import catalog, display, geo, listings
from thali.plans.registry import register, sql

ITEM_SEARCH, ITEM_CATEGORY = "RING", "ECONOMY"

_MONEY3 = "price, discount, final_price"


def _dbl(cols: str, alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return "replace (" + ", ".join(f"cast({a}{c.strip()} as double) as {c.strip()}" for c in cols.split(",")) + ")"


def _items_sql(kinds: tuple[str, ...], where: str = "true") -> str:
    parts = []
    for i, k in enumerate(("service", "menu")):
        if k not in kinds:
            continue
        t = "f_services" if k == "service" else "f_menu"
        parts.append(f"""select s.* {_dbl(_MONEY3)}, '{k}' item_type, coalesce(c.n, 0) times_ordered, {i} src
  from (select * from {t} where {where}) s left join c on c.item_type = '{k}' and c.item_id = s.id""")
    return sql("order_items", "services", "menu")(
        "with c as (select item_type, item_id, count(*) n from f_order_items group by 1, 2)\n"
        + "\nunion all\n".join(parts))


@register("items_listing", _items_sql(("service", "menu")))
def _o4(t):
    return catalog.items_listing(catalog.all_items(t["services"], t["menu"], t["order_items"]))


@register("all_items", _items_sql(("service", "menu")))
def _u2(t):
    return catalog.all_items(t["services"], t["menu"], t["order_items"])


@register("menu_items", _items_sql(("menu",)))
def _u2_menu(t):
    return catalog.all_items(t["services"], t["menu"], t["order_items"], item_type="menu")


@register("items_search", _items_sql(("service", "menu"),
                                     f"name ilike '%{ITEM_SEARCH}%' and category = '{ITEM_CATEGORY}'"))
def _f3(t):
    return catalog.all_items(t["services"], t["menu"], t["order_items"], "all", ITEM_SEARCH, ITEM_CATEGORY)


@register("items_times_ordered", sql("order_items", "services", "menu")("""
with c as (select item_type, item_id, count(*) n from f_order_items group by 1, 2)
select s.id, 'service' item_type, coalesce(c.n, 0) times_ordered
from f_services s left join c on c.item_type = 'service' and c.item_id = s.id
union all
select m.id, 'menu', coalesce(c.n, 0) from f_menu m left join c on c.item_type = 'menu' and c.item_id = m.id
"""))
def _j8(t):
    return catalog.all_items(t["services"], t["menu"], t["order_items"]).select("id", "item_type", "times_ordered")


@register("item_categories", sql("services", "menu")("""
select category, 'service' "type" from f_services where category is not null
union
select category, 'menu' from f_menu where category is not null
"""))
def _u1(t):
    return catalog.item_categories(t["services"], t["menu"])


def _money_sql(x: str) -> str:
    return f"case when {x} is null then '₹0.00' else '₹' || format('{{:,.2f}}', {x}) end"


@register("item_display", sql("services", "menu")(f"""
select * {_dbl(_MONEY3)}, {_money_sql('price')} price_formatted, {_money_sql('final_price')} final_price_formatted,
  case when coalesce(discount, 0) <> 0 then {_money_sql('discount')} end discount_formatted
from (select *, 'service' item_type from f_services union all select *, 'menu' from f_menu)
"""))
def _p10(t):
    return catalog.item_display(catalog.both_lists(t["services"], t["menu"]))


@register("order_items_photo", sql("order_items", "services", "menu")("""
with cat as (
  select 'service' kind, id, photo, 'sample_service' fallback from f_services
  union all select 'menu', id, photo, 'sample_food' from f_menu),
j as (
  select oi.*, coalesce(cat.photo, case when oi.item_type not in ('service', 'menu') then oi.item_photo end) item_photo_catalog,
    'https://res.cloudinary.com/demo/image/upload/v1633427556/' || case oi.item_type when 'service' then 'sample_service' else 'sample_food' end || '.jpg' standard
  from f_order_items oi left join cat on oi.item_type = cat.kind and oi.item_id = cat.id)
select * exclude (standard) replace (cast(price as double) as price, cast(total as double) as total),
  coalesce(nullif(item_photo, ''), nullif(item_photo_catalog, ''), standard) photo_url
from j
"""))
def _p8(t):
    return catalog.item_photos(listings.order_lines_with_catalog(t["order_items"], t["services"], t["menu"]))


def _ist_text(x: str) -> str:
    return f"coalesce(strftime({x} + interval 330 minute, '%d %b %Y, %I:%M %p'), '')"


def _indian_sql(x: str) -> str:
    plain = f"printf('%.2f', abs({x}))"
    whole = f"split_part({plain}, '.', 1)"
    frac = f"split_part({plain}, '.', 2)"
    head = f"left({whole}, length({whole}) - 3)"
    grouped = (f"case when length({whole}) <= 3 then {whole} else "
               f"ltrim(reverse(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right({whole}, 3) end")
    return (f"case when {x} is null then '₹0.00' else '₹' || case when {x} < 0 then '-' else '' end "
            f"|| {grouped} || '.' || {frac} end")


@register("order_display", sql("orders")(f"""
select order_id, order_date, cast(total_amount as double) total_amount,
  {_ist_text('order_date')} order_date_formatted,
  coalesce(split_part({_ist_text('order_date')}, ', ', 1), '') order_date_part,
  coalesce(split_part({_ist_text('order_date')}, ', ', 2), '') order_time_part,
  {_money_sql('total_amount')} total_amount_formatted,
  {_indian_sql('total_amount')} total_amount_indian
from f_orders
"""))
def _p1(t):
    return display.order_display(t["orders"])


def _case(col: str, table: dict, idx: int, default: str) -> str:
    whens = " ".join(f"when '{k}' then '{v[idx]}'" for k, v in table.items())
    return f"coalesce(case {col} {whens} end, {default})"


_OS, _PS, _U = display.ORDER_STATUS, display.PAYMENT_STATUS, display.UNKNOWN


@register("order_status_labels", sql("orders")(f"""
select * {_dbl('total_amount')},
  {_case('status', _OS, 0, "upper(left(status, 1)) || lower(substr(status, 2))")} status_name,
  {_case('status', _OS, 1, repr(_U[0]))} status_color,
  {_case('status', _OS, 2, repr(_U[1]))} status_icon,
  {_case('status', _OS, 3, repr(_U[2]))} status_badge,
  {_case('status', _OS, 4, repr(_U[3]))} status_badge_js
from f_orders
"""))
def _p2(t):
    return display.label_orders(t["orders"])


_PSS = "coalesce(payment_status, 'pending')"


@register("payment_status_labels", sql("payments")(f"""
select * {_dbl('amount')}, {_PSS} status_shown,
  {_case(_PSS, _PS, 0, "upper(left(" + _PSS + ", 1)) || lower(substr(" + _PSS + ", 2))")} status_name,
  {_case(_PSS, _PS, 1, repr(_U[0]))} status_color,
  {_case(_PSS, _PS, 2, repr(_U[1]))} status_icon,
  {_case(_PSS, _PS, 3, repr(_U[2]))} status_badge
from f_payments
"""))
def _p3(t):
    return display.label_payments(t["payments"])


@register("order_items_from_json", sql("orders")("""
with a as (select order_id, items from f_orders
           where json_valid(items) and json_type(items) = 'ARRAY')
select order_id, cast(i as integer) pos, cast(json_extract(items, '$[' || i || ']') as varchar) item_json,
  json_extract_string(items, '$[' || i || '].name') item_name,
  try_cast(json_extract_string(items, '$[' || i || '].quantity') as integer) quantity
from a, range(cast(json_array_length(items) as bigint)) r(i)
"""))
def _p4(t):
    return display.explode_order_items(t["orders"])


def _truncate_sql(x: str, n: int) -> str:
    head = f"left({x}, {n - 3})"
    return (f"case when {x} is null then '' when length({x}) <= {n + 5} then {x} "
            f"else regexp_replace({head}, ' [^ ]*$', '') || '...' end")


@register("customer_display", sql("users", "orders")(f"""
with j7 as (
  select u.*, coalesce(o.n, 0) total_orders, coalesce(o.spent, 0.0) total_spent
  from f_users u left join (
    select user_id, count(order_id) n, cast(sum(total_amount) as double) spent from f_orders group by user_id) o
  on u.id = o.user_id)
select *, {_ist_text('created_at')} created_at_formatted, {_ist_text('last_login')} last_login_formatted,
  case when starts_with(profile_pic, 'http') then profile_pic
       else 'https://res.cloudinary.com/demo/image/upload/v1633427556/default-avatar.png' end avatar_url,
  coalesce(total_spent / nullif(total_orders, 0), 0.0) avg_per_order,
  case when total_orders > 0 then 'Avg: ₹' || cast(round(cast(total_spent as decimal(28,2)) / total_orders) as bigint) else 'No orders' end avg_text,
  {_truncate_sql('email', 20)} email_short, {_truncate_sql('location', 15)} location_short,
  case when last_login is null then 'Never' else {_ist_text('last_login')} end last_login_shown,
  {_money_sql('total_spent')} total_spent_formatted
from j7
"""))
def _p9(t):
    return display.customer_display(listings.customer_rollup(t["users"], t["orders"]))


@register("customers_page_display", sql("users", "orders")(f"""
with first as (select * from f_users order by created_at desc nulls first, id limit 40),
pg as (
  select u.*, (select count(*) from f_orders o where o.user_id = u.id) total_orders,
    coalesce((select cast(sum(total_amount) as double) from f_orders o where o.user_id = u.id), 0.0) total_spent
  from first u order by created_at desc nulls first, id limit 20 offset 20)
select *, {_ist_text('created_at')} created_at_formatted, {_ist_text('last_login')} last_login_formatted,
  case when starts_with(profile_pic, 'http') then profile_pic
       else 'https://res.cloudinary.com/demo/image/upload/v1633427556/default-avatar.png' end avatar_url,
  coalesce(total_spent / nullif(total_orders, 0), 0.0) avg_per_order,
  case when total_orders > 0 then 'Avg: ₹' || cast(round(cast(total_spent as decimal(28,2)) / total_orders) as bigint) else 'No orders' end avg_text,
  {_truncate_sql('email', 20)} email_short, {_truncate_sql('location', 15)} location_short,
  case when last_login is null then 'Never' else {_ist_text('last_login')} end last_login_shown,
  {_money_sql('total_spent')} total_spent_formatted
from pg
"""))
def _customers_page(t):
    return display.customer_display(listings.customers_page(t["users"], t["orders"], 2))


@register("orders_page_display", sql("orders", "order_items", "payments")(f"""
with j as (
  select o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, o.total_amount, o.status, o.order_date, o.delivery_location,
    (select count(*) from f_order_items i where i.order_id = o.order_id) item_count, p.payment_status, p.payment_mode
  from f_orders o left join (select distinct order_id, payment_status, payment_mode from f_payments) p on o.order_id = p.order_id),
pg as (
  select * from j order by order_date desc nulls first, order_id, payment_status asc nulls last, payment_mode asc nulls last limit 20)
select * {_dbl('total_amount')}, {_ist_text('order_date')} order_date_formatted, {_money_sql('total_amount')} total_amount_formatted,
  case status when 'pending' then 'warning' when 'processing' then 'info' when 'completed' then 'success'
    when 'cancelled' then 'danger' when 'delivered' then 'success' else 'secondary' end status_class,
  {_truncate_sql('user_email', 20)} email_short
from pg
"""))
def _orders_page(t):
    return display.orders_page_display(listings.orders_page(t["orders"], t["order_items"], t["payments"], 1))


@register("order_timeline", sql("orders")(f"""
select order_id, 1 step_no, 'Order Placed' step, {_ist_text('order_date')} detail,
  coalesce(status = 'pending', false) active from f_orders
union all
select order_id, 2, 'Processing', 'Order is being processed', coalesce(status = 'processing', false) from f_orders
union all
select order_id, 3, 'Delivered', {_ist_text('delivery_date')}, coalesce(status = 'delivered', false) from f_orders
where {_ist_text('delivery_date')} <> ''
union all
select order_id, 4, 'Cancelled', 'Order was cancelled', true from f_orders where status = 'cancelled'
"""))
def _p11(t):
    return display.order_timeline(t["orders"])


@register("payment_display", sql("orders", "payments")(f"""
select o.order_id, p.payment_id, upper(coalesce(nullif(p.payment_status, ''), 'pending')) status_shown,
  {_money_sql('o.total_amount')} amount_formatted,
  coalesce(nullif(p.payment_mode, ''), 'N/A') mode_shown, coalesce(p.transaction_id, '') transaction_shown,
  {_ist_text('p.payment_date')} payment_date_formatted,
  nullif(p.razorpay_order_id, '') razorpay_order_shown, nullif(p.razorpay_payment_id, '') razorpay_payment_shown,
  case when p.razorpay_signature <> '' then left(p.razorpay_signature, 50) || '...' end signature_short
from f_orders o left join f_payments p on o.order_id = p.order_id
"""))
def _p12(t):
    return display.payment_display(t["orders"], t["payments"])


_DIGITS = "[0-9](_?[0-9])*"
_NUM = rf"^\s*[-+]?(({_DIGITS}([.]({_DIGITS})?)?|[.]{_DIGITS})(e[-+]?{_DIGITS})?|inf(inity)?|nan)\s*$"


def _num_sql(p: str) -> str:
    return f"case when regexp_matches(lower({p}), '{_NUM}') then try_cast(replace({p}, '_', '') as double) end"


@register("delivery_locations", sql("orders")(f"""
with s as (select order_id, delivery_location x, string_split(delivery_location, ' | ') parts from f_orders),
t as (select *, parts[2] p1, parts[3] p2 from s),
u as (select *, coalesce(x is not null and x <> '' and contains(x, ' | ') and len(parts) >= 4
        and (p1 = '' or ({_num_sql('p1')}) is not null) and (p2 = '' or ({_num_sql('p2')}) is not null), false) packed,
      x is null or x = '' empty from t)
select order_id, x location_text,
  case when empty then '' when packed then parts[1] else x end address,
  case when packed and p1 <> '' then {_num_sql('p1')} end latitude,
  case when packed and p2 <> '' then {_num_sql('p2')} end longitude,
  case when packed then parts[4] end map_link,
  packed is_auto_detected,
  case when not empty then x end full_string
from u
"""))
def _p5(t):
    return geo.parse_locations(t["orders"])


def _depots(t):
    """Depots derived from the data: one per city, at the mean valid point."""
    a = t["addresses"]
    ok = geo.valid_point(F.col("latitude"), F.col("longitude"))
    return (a.where(ok).groupBy("city")
            .agg(F.round(F.avg("latitude"), 4).alias("latitude"), F.round(F.avg("longitude"), 4).alias("longitude"))
            .select(F.regexp_extract("city", r"(\d+)$", 1).cast("long").alias("depot_id"), "latitude", "longitude"))


def _hav_sql(a1: str, o1: str, a2: str, o2: str) -> str:
    return (f"(2 * 6371.0 * atan2(sqrt(sin(radians({a2} - {a1}) / 2) * sin(radians({a2} - {a1}) / 2) + "
            f"cos(radians({a1})) * cos(radians({a2})) * sin(radians({o2} - {o1}) / 2) * sin(radians({o2} - {o1}) / 2)), "
            f"sqrt(1 - (sin(radians({a2} - {a1}) / 2) * sin(radians({a2} - {a1}) / 2) + "
            f"cos(radians({a1})) * cos(radians({a2})) * sin(radians({o2} - {o1}) / 2) * sin(radians({o2} - {o1}) / 2)))))")


_VALID = "{a} is not null and {o} is not null and {a} between -90 and 90 and {o} between -180 and 180"


@register("depot_distance", sql("addresses")(f"""
with d as (
  select cast(regexp_extract(city, '(\\d+)$', 1) as bigint) depot_id, round(avg(latitude), 4) lat, round(avg(longitude), 4) lon
  from f_addresses where {_VALID.format(a='latitude', o='longitude')} group by city),
c as (
  select a.address_id, d.depot_id, {_hav_sql('a.latitude', 'a.longitude', 'd.lat', 'd.lon')} km
  from f_addresses a, d where {_VALID.format(a='a.latitude', o='a.longitude')}),
b as (select address_id, arg_min(depot_id, (km, depot_id)) depot_id, round(min(km), 2) distance from c group by address_id)
select a.address_id, a.user_id, a.latitude, a.longitude, b.depot_id, b.distance
from f_addresses a left join b on a.address_id = b.address_id
"""))
def _p7(t):
    return geo.nearest_depot(t["addresses"], _depots(t))


def _enc(x: str) -> str:
    e = f"url_encode({x})"
    for code, raw in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        e = f"replace({e}, '{code}', '{raw}')"
    return e


def _dms_sql(c: str, pos: str, neg: str) -> str:
    a = f"abs({c})"
    deg = f"floor({a})"
    md = f"(({a} - {deg}) * 60)"
    return (f"cast(cast({deg} as bigint) as varchar) || '° ' || cast(cast(floor({md}) as bigint) as varchar) "
            f"|| ''' ' || printf('%.2f', ({md} - floor({md})) * 60) || '\" ' "
            f"|| case when {c} >= 0 then '{pos}' else '{neg}' end")


_FMT = ("concat_ws(', ', nullif(address_line1, ''), nullif(address_line2, ''), 'Near ' || nullif(landmark, ''), "
        "nullif(city, ''), nullif(state, ''), 'Pincode: ' || nullif(pincode, ''))")
_V = _VALID.format(a="latitude", o="longitude")
_L6, _O6 = "printf('%.6f', latitude)", "printf('%.6f', longitude)"
_LT, _OT = "cast(latitude as varchar)", "cast(longitude as varchar)"
_ADDR_ORACLE = f"""
with a as (select x.*, u.phone _user_phone, {_FMT} fa from f_addresses x left join f_users u on x.user_id = u.id)
select * exclude (_user_phone, fa), fa formatted_address,
  coalesce(cast(city as varchar), 'null') || ', ' || coalesce(cast(state as varchar), 'null') || ' - '
    || coalesce(cast(pincode as varchar), 'null') city_line,
  _user_phone phone_shown,
  coalesce({_V}, false) has_valid_coordinates,
  case when latitude is not null and longitude is not null then 'https://www.google.com/maps?q='
    || {_LT} || ',' || {_OT} || '&z=15' end map_link,
  case when latitude is not null and longitude is not null then 'https://www.google.com/maps?q='
    || {_LT} || ',' || {_OT} end map_link_plain,
  case when {_V} then 'https://www.google.com/maps?q=' || {_L6} || ',' || {_O6} || '&z=15'
    || case when trim(fa) <> '' then '&layer=c&cbll=' || {_L6} || ',' || {_O6} || '&cbp=' else '' end end map_link_view,
  case when {_V} then 'https://www.google.com/maps/dir/?api=1'
    || case when fa <> '' then '&origin=' || {_enc('trim(fa)')} else '' end
    || '&destination=' || {_L6} || ',' || {_O6} || '&travelmode=driving' end directions_link,
  case when {_V} then 'https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=' || {_L6} || ',' || {_O6}
    end street_view_link,
  case when {_V} then {_L6} end latitude_text,
  case when {_V} then {_O6} end longitude_text,
  case when {_V} then {_dms_sql('latitude', 'N', 'S')} end latitude_dms,
  case when {_V} then {_dms_sql('longitude', 'E', 'W')} end longitude_dms
from a
"""


@register("address_enrichment", sql("addresses", "users")(_ADDR_ORACLE))
def _p6(t):
    return geo.enrich_addresses(t["addresses"], t["users"])
