"""Business tables derived from the driver's TPC-H-like parquet.

One SQL text per table serves both Spark and the DuckDB oracle, so the
operator under test is the only thing written twice.  ``${name}`` marks an
input table and four macros cover the dialect differences:

=========  ==========================================  =====================
macro      Spark                                       DuckDB
=========  ==========================================  =====================
TS('x')    timestamp_ntz'x'                            timestamp 'x'
MIN[e]     make_dt_interval(0,0,cast(e as int),0)      to_minutes(e)
DAY[e]     make_dt_interval(cast(e as int),0,0,0)      to_days(cast(e as int))
EACH[..]   lateral view explode(array(..)) z as k      , unnest([..]) z(k)
=========  ==========================================  =====================

Names and item texts come by a left join to a side that is grouped by its key,
so the optimiser drops the join where a query does not read them.

In Spark the text runs through ``spark.sql(text, name=DataFrame)``, so no
temporary view is registered and every input is a lazily planned frame.
"""

from __future__ import annotations

import re

# Fixed adapter texts (see FIXTURES.md); dates stored as UTC TIMESTAMP_NTZ.
# Coordinates pass through DECIMAL(10,2) so both engines hold the same double
# (DuckDB's floating-point sum gave 19.009999999999998 where Spark gave 19.01).
ADAPTER_SQL: dict[str, str] = {
    "users": """
select c_custkey id, c_name full_name,
  concat('+91', cast(9000000000+c_custkey as varchar(20))) phone,
  concat('user',cast(c_custkey as varchar(20)),'@example.org') email,
  case when c_custkey%3=0 then null when c_custkey%3=1 then concat('http://img.example.org/u/',cast(c_custkey as varchar(20))) else 'local.png' end profile_pic,
  c_mktsegment location, c_acctbal>=0 is_active,
  TS('1995-01-01 18:00:00')+DAY[c_custkey%2000] created_at,
  case when c_custkey%7=0 then null else TS('1995-01-01 18:00:00')+DAY[2000+c_custkey%400] end last_login
from ${customer}
""",
    "orders": """
select o_orderkey order_id, o_custkey user_id, c_name user_name,
  concat('+91', cast(9000000000+o_custkey as varchar(20))) user_phone,
  concat('user', cast(o_custkey as varchar(20)), '@example.org') user_email,
  cast(o_totalprice as decimal(18,2)) total_amount,
  case substr(o_orderpriority,1,1) when '1' then 'pending' when '2' then 'processing' when '3' then 'completed' when '4' then 'cancelled' else 'delivered' end status,
  case when o_orderkey%11=0 then null else case o_orderkey%5 when 0 then 'COD' when 1 then 'Online' when 2 then 'Card' when 3 then 'Wallet' else 'UPI' end end payment_mode,
  case o_orderkey%4 when 0 then concat('Lane ',cast(o_orderkey%97 as varchar(9)),' | ',cast(8+o_orderkey%29 as varchar(9)),'.5 | ',cast(68+o_orderkey%29 as varchar(9)),'.25 | http://maps.example.org') when 1 then 'Lane | bad | 70.1 | http://maps.example.org' when 2 then concat('Lane ',cast(o_orderkey%97 as varchar(9))) else null end delivery_location,
  case o_orderkey%4 when 0 then '[{"name":"a","quantity":2},{"name":"b","quantity":1}]' when 1 then '{"name":"z"}' when 2 then 'bad' else '[]' end items,
  o_orderdate+MIN[(o_orderkey*37)%1440] order_date,
  case when substr(o_orderpriority,1,1)='5' then o_orderdate+MIN[(o_orderkey*37)%1440]+DAY[2] end delivery_date,
  cast(null as varchar(9)) notes
from ${orders} left join (select c_custkey, min(c_name) c_name from ${customer} group by c_custkey) c on o_custkey=c_custkey
""",
    "order_items": """
select l_orderkey order_id, l_linenumber line_no,
  case when l_partkey%3=0 then 'service' else 'menu' end item_type,
  l_partkey item_id, p_name item_name,
  case when l_partkey%4=0 then concat('http://img.example.org/i/',cast(l_partkey as varchar(20))) when l_partkey%4=1 then '' end item_photo,
  cast(l_quantity as int) quantity,
  cast(floor(l_extendedprice/l_quantity) as decimal(18,2)) price,
  cast(l_extendedprice as decimal(18,2)) total
from ${lineitem} left join (select p_partkey, min(p_name) p_name from ${part} group by p_partkey) p on l_partkey=p_partkey
""",
    "payments": """
select order_id*10+k payment_id, order_id, user_id, total_amount amount, payment_mode,
  case when k=2 then 'refunded' else case order_id%4 when 0 then 'pending' when 3 then 'failed' else 'completed' end end payment_status,
  case when order_id%3=0 then concat('tx',cast(order_id as varchar(20))) end transaction_id,
  case when k<2 and order_id%4 in (1,2) then order_date end payment_date,
  case when order_id%6=0 then concat('order_',cast(order_id as varchar(20))) when order_id%6=1 then '' end razorpay_order_id,
  case when order_id%6=0 then concat('pay_',cast(order_id as varchar(20))) end razorpay_payment_id,
  case order_id%6 when 0 then repeat(concat('s',cast(order_id as varchar(20))),12) when 1 then '' when 2 then concat('sig',cast(order_id as varchar(20))) end razorpay_signature
from ${f_orders} EACH[0,1,2]
where order_id%10<>0 and (k=0 or (k=1 and order_id%70=3) or (k=2 and order_id%50=1))
""",
    "addresses": """
select c_custkey*2+k address_id, c_custkey user_id, k=0 is_default,
  concat('Flat ',cast(c_custkey%50 as varchar(9))) address_line1,
  case when c_custkey%2=0 then 'Block A' else '' end address_line2,
  case when c_custkey%5=0 then 'Park' end landmark,
  concat('City',cast(c_custkey%9 as varchar(9))) city, 'State' state,
  case when c_custkey%6=0 then null else cast(400000+c_custkey%999 as varchar(9)) end pincode,
  case when c_custkey%13=0 then null when c_custkey%17=0 then 95.0 when c_custkey%19=0 then 0.0 else cast(cast(8.0+((c_custkey*7919+k*101)%2900)/100.0 as decimal(10,2)) as double) end latitude,
  cast(cast(68.0+((c_custkey*104729+k*211)%2900)/100.0 as decimal(10,2)) as double) longitude
from ${customer} EACH[0,1]
where (k=0 and c_custkey%10<>9) or (k=1 and c_custkey%2=0)
""",
    "services": """
select p_partkey id, p_name name, case when p_size%10=0 then null else p_type end category,
  case when p_size%7=0 then null else p_size end position,
  cast(p_retailprice as decimal(18,2)) price, cast(p_size%3 as decimal(18,2)) discount,
  cast(p_retailprice as decimal(18,2))-cast(p_size%3 as decimal(18,2)) final_price,
  concat('http://img.example.org/c/',cast(p_partkey as varchar(20))) photo
from ${part} where p_partkey%3=0
""",
    "menu": """
select p_partkey id, p_name name, case when p_size%10=0 then null else p_type end category,
  case when p_size%7=0 then null else p_size end position,
  cast(p_retailprice as decimal(18,2)) price, cast(p_size%3 as decimal(18,2)) discount,
  cast(p_retailprice as decimal(18,2))-cast(p_size%3 as decimal(18,2)) final_price,
  concat('http://img.example.org/c/',cast(p_partkey as varchar(20))) photo
from ${part} where p_partkey%3<>0
""",
}

# Raw driver tables each business table reads (``f_orders`` = adapted orders).
ADAPTER_INPUTS: dict[str, tuple[str, ...]] = {
    "users": ("customer",),
    "orders": ("orders", "customer"),
    "order_items": ("lineitem", "part"),
    "payments": ("f_orders",),
    "addresses": ("customer",),
    "services": ("part",),
    "menu": ("part",),
}

_MACROS = {
    "spark": {
        "TS": lambda a: f"timestamp_ntz{a}",
        "MIN": lambda e: f"make_dt_interval(0,0,cast({e} as int),0)",
        "DAY": lambda e: f"make_dt_interval(cast({e} as int),0,0,0)",
        "EACH": lambda e: f"lateral view explode(array({e})) z as k",
    },
    "duckdb": {
        "TS": lambda a: f"timestamp {a}",
        "MIN": lambda e: f"to_minutes({e})",
        "DAY": lambda e: f"to_days(cast({e} as int))",
        "EACH": lambda e: f", unnest([{e}]) z(k)",
    },
}


def render(name: str, dialect: str) -> str:
    """The adapter text of ``name`` for ``dialect`` ('spark' or 'duckdb').

    For Spark, table tokens become ``{name}`` placeholders for
    ``spark.sql(text, **frames)`` and literal braces are escaped; for DuckDB
    they become plain view/CTE names (``f_orders`` stays a CTE name).
    """
    text = ADAPTER_SQL[name]
    macros = _MACROS[dialect]
    text = re.sub(r"TS\(('[^']*')\)", lambda m: macros["TS"](m.group(1)), text)
    text = re.sub(r"MIN\[([^\]]*)\]", lambda m: macros["MIN"](m.group(1)), text)
    text = re.sub(r"DAY\[([^\]]*)\]", lambda m: macros["DAY"](m.group(1)), text)
    text = re.sub(r"EACH\[([^\]]*)\]", lambda m: macros["EACH"](m.group(1)), text)
    if dialect == "spark":
        text = text.replace("{", "{{").replace("}", "}}")
        return re.sub(r"\$\{\{(\w+)\}\}", r"{\1}", text)
    return re.sub(r"\$\{(\w+)\}", r"\1", text)


def duckdb_ctes(*names: str) -> str:
    """``WITH`` clause defining ``f_<name>`` for each business table needed.

    ``payments`` pulls in ``orders`` first, since its text reads ``f_orders``.
    """
    ordered: list[str] = []
    for name in names:
        if name == "payments" and "orders" not in ordered:
            ordered.append("orders")
        if name not in ordered:
            ordered.append(name)
    parts = [f"f_{n} as ({render(n, 'duckdb').strip()})" for n in ordered]
    return "with " + ",\n".join(parts)
