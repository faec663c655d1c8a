"""Hand-written expectations on tiny frames with the edge cases."""

import math
import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import orders as make_orders
from thali.functions.temporal import check_range, ist_date
from thali.functions.numbers import plain_float_text
from thali.functions.text import money_indian_text, money_text, template_truncate
from thali.operators import changes, display, geo, kpis, listings


def test_ist_day_boundary(spark):
    o = make_orders(spark)
    days = {r["order_id"]: r["d"] for r in o.select("order_id", ist_date("order_date").alias("d")).collect()}
    assert days[1] == date(2024, 1, 1) and days[2] == date(2024, 1, 2)
    k = kpis.period_kpis(o, "today", as_of=date(2024, 1, 2)).first()
    # orders 2, 3, 4, 6, 7 fall on IST 2024-01-02; order 1 (18:29:59 UTC) does not
    assert k["total_orders"] == 5 and k["today_orders"] == 5
    # revenue excludes cancelled; NULL status and NULL amount add nothing
    assert k["total_revenue"] == 200.0 + 1234567.0 + 10.0
    assert k["pending_orders"] == 0 and k["completed_orders"] == 2 and k["cancelled_orders"] == 0


def test_kpis_all_time_and_empty(spark):
    o = make_orders(spark)
    k = kpis.period_kpis(o, "all", as_of=date(2024, 1, 2)).first()
    assert k["total_orders"] == 7 and k["total_customers"] == 4 and k["cancelled_orders"] == 1
    empty = kpis.period_kpis(o.limit(0), "all", as_of=date(2024, 1, 2)).first()
    assert empty["avg_order_value"] == 0.0 and empty["total_revenue"] == 0.0


def test_status_invariants(spark):
    o = make_orders(spark)
    counts = kpis.status_counts(o).collect()
    assert sum(r["count"] for r in counts) == 7
    parts = kpis.status_summary(kpis.period_kpis(o, "all", as_of=date(2024, 1, 2))).collect()
    by = {r["part"]: r["orders"] for r in parts}
    assert by["pending"] + by["processing"] + by["completed"] + by["cancelled"] == by["total"]


def test_search_wildcards_kept(spark):
    o = make_orders(spark)
    hits = {r["order_id"] for r in listings.search_orders(o, "%_o").collect()}
    assert 7 in hits  # '%' and '_' act as wildcards (kept)
    assert {r["order_id"] for r in listings.search_orders(o, "ASHA").collect()} == {1, 2}


def test_money_texts(spark):
    df = spark.createDataFrame([(Decimal("1234567.00"),), (Decimal("-5.50"),), (None,), (Decimal("999.00"),)],
                               "x decimal(18,2)")
    got = [(r[0], r[1]) for r in df.select(money_text("x"), money_indian_text("x")).collect()]
    assert got == [("₹1,234,567.00", "₹12,34,567.00"), ("₹-5.50", "₹-5.50"), ("₹0.00", "₹0.00"),
                   ("₹999.00", "₹999.00")]


def test_order_display_null_date(spark):
    r = {x["order_id"]: x for x in display.order_display(make_orders(spark)).collect()}
    assert r[5]["order_date_formatted"] == "" and r[5]["order_time_part"] == ""
    assert r[1]["order_date_formatted"] == "01 Jan 2024, 11:59 PM"
    assert r[2]["order_date_formatted"] == "02 Jan 2024, 12:00 AM"


def test_status_labels_unknown(spark):
    r = {x["order_id"]: x for x in display.label_orders(make_orders(spark)).collect()}
    assert r[6]["status_badge"] == "secondary" and r[6]["status_icon"] == "question-circle"
    assert r[2]["status_badge"] == "success" and r[2]["status_badge_js"] == "bg-primary"
    act = {x["order_id"]: x["status_badge"] for x in listings.recent_activity(make_orders(spark)).collect()}
    assert act[2] == "secondary"


def test_items_json_forms(spark):
    df = spark.createDataFrame(
        [(1, '[{"name":"a","quantity":2},{"name":"b"}]'), (2, '{"name":"z"}'), (3, "bad"), (4, "[]"), (5, None)],
        "order_id long, items string")
    rows = display.explode_order_items(df).collect()
    assert [(r["order_id"], r["pos"], r["item_name"], r["quantity"]) for r in rows] == [(1, 0, "a", 2), (1, 1, "b", None)]


def test_location_parsing(spark):
    texts = ["", "A | 1 | 2", "A | 1 | 2 | L", "A |  |  | L", "A | 1 | 2 | L | X", "A | 1.5d | 2 | L", None]
    df = spark.createDataFrame(list(enumerate(texts)), "order_id long, delivery_location string")
    r = {x["order_id"]: x for x in geo.parse_locations(df).collect()}
    assert r[0]["address"] == "" and r[0]["full_string"] is None and not r[0]["is_auto_detected"]
    assert r[1]["address"] == "A | 1 | 2" and not r[1]["is_auto_detected"]
    assert (r[2]["address"], r[2]["latitude"], r[2]["longitude"], r[2]["map_link"]) == ("A", 1.0, 2.0, "L")
    assert r[3]["is_auto_detected"] and r[3]["latitude"] is None and r[3]["address"] == "A"
    assert r[4]["map_link"] == "L" and r[4]["is_auto_detected"]
    assert r[5]["address"] == "A | 1.5d | 2 | L" and not r[5]["is_auto_detected"]
    assert r[6]["address"] == "" and r[6]["full_string"] is None


def test_addresses_and_depots(spark):
    a = spark.createDataFrame(
        [(1, 1, True, "Flat 1", "", "Park", "Pune", "MH", "411001", 18.5204, 73.8567),
         (2, 2, True, "Flat 2", "Block A", None, "Mumbai", "MH", None, 19.0760, 72.8777),
         (3, 3, True, "X", None, None, None, None, None, 95.0, 10.0),
         (4, 4, True, "Y", None, None, None, None, None, 0.0, 0.0),
         (5, 5, True, "Z", None, None, None, None, None, None, 10.0)],
        "address_id long, user_id long, is_default boolean, address_line1 string, address_line2 string, "
        "landmark string, city string, state string, pincode string, latitude double, longitude double")
    r = {x["address_id"]: x for x in geo.enrich_addresses(a).collect()}
    assert r[1]["formatted_address"] == "Flat 1, Near Park, Pune, MH, Pincode: 411001"
    assert r[2]["formatted_address"] == "Flat 2, Block A, Mumbai, MH"
    assert r[3]["has_valid_coordinates"] is False and r[4]["has_valid_coordinates"] is True
    assert r[1]["latitude_text"] == "18.520400" and r[1]["latitude_dms"].endswith('" N')
    assert r[1]["map_link"] == "https://www.google.com/maps?q=18.5204,73.8567&z=15"
    depots = spark.createDataFrame([(1, 18.5204, 73.8567), (2, 28.7041, 77.1025), (3, 13.0827, 80.2707)],
                                   "depot_id long, latitude double, longitude double")
    n = {x["address_id"]: x for x in geo.nearest_depot(a, depots).collect()}
    assert n[1]["depot_id"] == 1 and n[1]["distance"] == 0.0
    assert n[2]["depot_id"] == 1 and 115 < n[2]["distance"] < 125
    assert n[3]["depot_id"] is None and n[5]["distance"] is None
    d = spark.createDataFrame([(1,)], "x int").select(
        geo.haversine(F.lit(19.0760), F.lit(72.8777), F.lit(28.7041), F.lit(77.1025)).alias("km")).first()
    assert abs(d["km"] - 1153.24) < 0.01  # Mumbai-Delhi great circle


def test_status_changes(spark):
    o = make_orders(spark)
    batch = spark.createDataFrame(
        [(1, "processing", "first", "u", 1), (1, "completed", None, "u", 2), (2, "bogus", None, "u", 1),
         (99, "pending", None, "u", 1), (3, "cancelled", "", "u", 1)],
        "order_id long, new_status string, notes string, changed_by string, seq long")
    res = changes.apply_status_changes(o, batch)
    snap = {r["order_id"]: r for r in res.snapshot.collect()}
    assert snap[1]["status"] == "completed" and snap[1]["notes"] == "first"
    assert snap[3]["status"] == "cancelled" and snap[3]["notes"] == ""
    assert snap[2]["status"] == "delivered"
    hist = sorted((r["order_id"], r["seq"], r["old_status"], r["new_status"]) for r in res.history.collect())
    assert hist == [(1, 1, "pending", "processing"), (1, 2, "processing", "completed"), (3, 1, None, "cancelled")]
    rej = {(r["order_id"], r["reason"]) for r in res.rejects.collect()}
    assert rej == {(2, "invalid_status"), (99, "unknown_order")}
    same = changes.apply_status_changes(o, batch.limit(0)).snapshot
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, o.collect()))


def test_payment_changes(spark):
    o = make_orders(spark)
    pay = spark.createDataFrame(
        [(10, 1, 10, Decimal("100.50"), "COD", "pending", None, None),
         (11, 1, 10, Decimal("100.50"), "COD", "failed", "t0", None)],
        "payment_id long, order_id long, user_id long, amount decimal(18,2), payment_mode string, "
        "payment_status string, transaction_id string, payment_date timestamp_ntz")
    t1, t2 = datetime(2024, 1, 5, 10, 0), datetime(2024, 1, 6, 10, 0)
    batch = spark.createDataFrame(
        [(1, "completed", "tx1", t1, 1), (1, "refunded", "", t2, 2), (2, "completed", "", t1, 1),
         (2, "completed", "tx2", t2, 2), (99, "completed", "x", t1, 1)],
        "order_id long, payment_status string, transaction_id string, changed_at timestamp_ntz, seq long")
    res = changes.apply_payment_changes(pay, o, batch)
    snap = sorted(res.snapshot.collect(), key=lambda r: (r["order_id"], r["payment_id"] or 0))
    assert [(r["order_id"], r["payment_status"], r["transaction_id"], r["payment_date"]) for r in snap] == [
        (1, "refunded", "tx1", t1), (1, "refunded", "tx1", t1), (2, "completed", "tx2", t2)]
    assert {r["reason"] for r in res.rejects.collect()} == {"unknown_order"}
    assert res.history.count() == 4


def test_check_range():
    assert check_range("2024-01-01", "2024-12-31") == (date(2024, 1, 1), date(2024, 12, 31))
    for a, b in [("", "2024-01-01"), ("2024-02-01", "2024-01-01"), ("2023-01-01", "2024-12-31"), ("x", "y")]:
        try:
            check_range(a, b)
        except ValueError:
            continue
        raise AssertionError((a, b))


def test_pages_concatenate(spark):
    o = make_orders(spark)
    empty_items = spark.createDataFrame([], "order_id long, line_no int")
    empty_pay = spark.createDataFrame([], "order_id long, payment_status string, payment_mode string")
    listing = listings.orders_listing(o, empty_items, empty_pay)
    page = listings.orders_page(o, empty_items, empty_pay, 1).collect()
    assert [r["order_id"] for r in page][:3] == [5, 7, 6]  # NULL date first, then newest
    counts = listings.page_counts(listing).first()
    assert counts["total_count"] == 7 and counts["total_pages"] == 1
    after = listings.keyset_after(listing, [("order_date", True), ("order_id", False)],
                                  (datetime(2024, 1, 2, 7, 0), 6))
    assert [r["order_id"] for r in after.orderBy(*listings._listing_sort()).collect()] == [4, 3, 2, 1]


def test_texts_independent_of_session_zone(spark):
    # IST 1997-04-06 02:14 lies in Los Angeles' DST gap; the text must not move
    df = spark.createDataFrame([(1, datetime(1997, 4, 5, 20, 44))], "order_id long, order_date timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = df.select(display.ist_text("order_date")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == "06 Apr 1997, 02:14 AM"


def test_payment_panel(spark):
    orders = spark.createDataFrame([(1, Decimal("1234567.00")), (2, None)], "order_id long, total_amount decimal(18,2)")
    pay = spark.createDataFrame(
        [(10, 1, "", "", None, "short", "", None), (11, 1, "failed", "Card", "t", "s" * 60, "o", "p"), (12, 2, None, None, "", "", None, "")],
        "payment_id long, order_id long, payment_status string, payment_mode string, transaction_id string, razorpay_signature string, "
        "razorpay_order_id string, razorpay_payment_id string").withColumn("payment_date", F.lit(None).cast("timestamp_ntz"))
    r = {x["payment_id"]: x for x in display.payment_display(orders, pay).collect()}
    assert r[10]["amount_formatted"] == "₹1,234,567.00" and r[12]["amount_formatted"] == "₹0.00"
    assert (r[10]["signature_short"], r[11]["signature_short"], r[12]["signature_short"]) == ("short...", "s" * 50 + "...", None)
    assert (r[10]["status_shown"], r[10]["mode_shown"]) == ("PENDING", "N/A") and r[11]["status_shown"] == "FAILED"
    assert (r[11]["razorpay_order_shown"], r[11]["razorpay_payment_shown"], r[12]["razorpay_payment_shown"]) == ("o", "p", None)


def test_template_truncate(spark):
    texts = {"a" * 25: "a" * 25, "a" * 26: "a" * 17 + "...", "ab cd ef gh ij kl mn op qr st": "ab cd ef gh ij...",
             "": "", None: "", "one twothreefourfivesixseven": "one..."}
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", template_truncate("x", 20).alias("y")).collect()}
    assert got == texts


def test_coordinates_as_text(spark):
    values = [0.0005, 0.00012, 5e-05, 1.25e-07, 0.001, 12.5, 0.0, -0.0005, 10.0, 12345678.5, -179.999999, 95.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", plain_float_text("x").alias("y")).collect():
        assert r["y"] == str(r["x"])


def test_location_numbers_as_python_reads_them(spark):
    good = ["1.e5", "1_0.", ".5", "1_000.2_5e1_0", " 7 ", "+3", "inf", "-Infinity", "nan"]
    bad = ["1__0", "_1", "1_", ".", "e5", "1e", "1.5d", "0x1"]
    df = spark.createDataFrame([(i, f"A | {x} | 2 | L") for i, x in enumerate(good + bad)], "order_id long, delivery_location string")
    auto = {r["order_id"]: r["is_auto_detected"] for r in geo.parse_locations(df).collect()}
    for i, x in enumerate(good):
        float(x)
        assert auto[i], x
    for i, x in enumerate(bad, len(good)):
        assert not auto[i], x


def _near(spark, points, depots):
    a = spark.createDataFrame([(i, i, *p) for i, p in enumerate(points)], "address_id long, user_id long, latitude double, longitude double")
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(depots)], "depot_id long, latitude double, longitude double")
    return {r["address_id"]: (r["depot_id"], r["distance"]) for r in geo.nearest_depot(a, d).collect()}


def test_nearest_of_many_depots(spark):
    rng = random.Random(4)
    depots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(6000)]
    depots += [(19 + rng.gauss(0, 0.01), 73 + rng.gauss(0, 0.01)) for _ in range(6000)]  # a dense town
    depots += [(19.0, 73.0), (19.0, 73.0), (90.0, 0.0), (-90.0, 10.0), (5.0, 180.0), (5.0, -180.0), (100.0, 0.0)]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    points += [(19 + rng.gauss(0, 0.02), 73 + rng.gauss(0, 0.02)) for _ in range(60)]
    points += [(89.9, 100.0), (-89.99, -20.0), (5.0, 179.999), (19.0, 73.0), (91.0, 0.0)]
    got = _near(spark, points, depots)

    def km(p, q):
        (a, b), (c, d) = ([math.radians(x) for x in y] for y in (p, q))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for i, p in enumerate(points[:-1]):
        best, at = min((km(p, q), j) for j, q in enumerate(depots[:-1]))
        assert got[i][1] == round(best, 2) and km(p, depots[got[i][0]]) <= best + 1e-9, (p, got[i], best, at)
    assert got[len(points) - 1] == (None, None)
    assert got[len(points) - 2][0] == 12000  # equal distance: the lower id


def test_nearest_of_two_depots_metres_apart(spark):
    got = _near(spark, [(19.0, 73.0), (19.00003, 73.0)], [(19.00003, 73.0), (19.0, 73.0)])
    assert got == {0: (1, 0.0), 1: (0, 0.0)}
    assert _near(spark, [(1.0, 1.0)], []) == {0: (None, None)}


def test_nearest_of_very_many_depots_in_one_block(spark):
    """100,000 depots within 300 metres: cells are cut until few are in one."""
    rng = random.Random(9)
    depots = spark.range(100_000).select(
        F.col("id").alias("depot_id"), (19 + F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003 * 0.0027).alias("latitude"),
        (73 + F.pmod(F.xxhash64(F.col("id") + 7), F.lit(100_019)) / 100_019 * 0.0027).alias("longitude"))
    places = [(r["latitude"], r["longitude"]) for r in depots.orderBy("depot_id").collect()]
    points = [(19 + rng.uniform(-0.001, 0.004), 73 + rng.uniform(-0.001, 0.004)) for _ in range(30)]
    a = spark.createDataFrame([(i, i, *p) for i, p in enumerate(points)], "address_id long, user_id long, latitude double, longitude double")
    got = {r["address_id"]: (r["depot_id"], r["distance"]) for r in geo.nearest_depot(a, depots).collect()}
    for i, (x, y) in enumerate(points):
        best = min(range(len(places)), key=lambda j: (x - places[j][0]) ** 2 + ((y - places[j][1]) * math.cos(math.radians(19))) ** 2)
        flat = lambda j: math.hypot(x - places[j][0], (y - places[j][1]) * math.cos(math.radians(19)))
        assert flat(got[i][0]) <= flat(best) * 1.0001, (i, got[i], best)


def test_status_tables(spark):
    # Fixed values, written out here a second time.
    orders = {
        "pending": ("Pending", "#ffc107", "clock", "warning", "bg-warning"), "processing": ("Processing", "#17a2b8", "cogs", "info", "bg-info"),
        "completed": ("Completed", "#28a745", "check-circle", "success", "bg-success"),
        "cancelled": ("Cancelled", "#dc3545", "times-circle", "danger", "bg-danger"),
        "delivered": ("Delivered", "#20c997", "truck", "success", "bg-primary"), "held": ("Held", "#6c757d", "question-circle", "secondary", "bg-secondary")}
    df = spark.createDataFrame([(s,) for s in orders], "status string")
    got = {r["status"]: (r["status_name"], r["status_color"], r["status_icon"], r["status_badge"], r["status_badge_js"])
           for r in display.label_orders(df).collect()}
    assert got == orders
    payments = {
        "pending": ("Pending", "#ffc107", "clock", "warning"), "completed": ("Completed", "#28a745", "check-circle", "success"),
        "failed": ("Failed", "#dc3545", "times-circle", "danger"), "refunded": ("Refunded", "#6c757d", "undo", "secondary"),
        "cancelled": ("Cancelled", "#dc3545", "ban", "danger")}
    df = spark.createDataFrame([(s,) for s in payments], "payment_status string")
    got = {r["payment_status"]: (r["status_name"], r["status_color"], r["status_icon"], r["status_badge"]) for r in display.label_payments(df).collect()}
    assert got == payments


def test_changes_with_equal_seq_agree_in_every_output(spark):
    o = make_orders(spark)
    rows = [(1, "completed", "b", "u", 1), (1, "processing", "a", "u", 1), (1, "cancelled", None, "u", 1)]
    schema = "order_id long, new_status string, notes string, changed_by string, seq long"
    for order in (rows, rows[::-1]):
        res = changes.apply_status_changes(o, spark.createDataFrame(order, schema).repartition(3))
        last = [r["new_status"] for r in res.history.collect() if r["new_status"] not in {x["old_status"] for x in res.history.collect()}]
        assert {r["order_id"]: r["status"] for r in res.snapshot.collect()}[1] == last[0] == "processing"


def test_inserted_payments_get_ids_of_their_own(spark):
    o = make_orders(spark)
    pay = spark.createDataFrame([(500, 1, 10, Decimal("1.00"), "COD", "pending", None, None)],
                                "payment_id long, order_id long, user_id long, amount decimal(18,2), payment_mode string, "
                                "payment_status string, transaction_id string, payment_date timestamp_ntz")
    batch = o.select("order_id", F.lit("completed").alias("payment_status"), F.lit("t").alias("transaction_id"),
                     F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz").alias("changed_at"), F.lit(1).cast("long").alias("seq"))
    ids = [r["payment_id"] for r in changes.apply_payment_changes(pay, o, batch).snapshot.collect()]
    assert None not in ids and len(ids) == len(set(ids)) == 7
    none = changes.apply_payment_changes(pay.limit(0), o, batch).snapshot
    assert none.where("payment_id is null").count() == 0 and none.count() == 7


def test_days_zero_is_not_the_default_week(spark):
    o = make_orders(spark)
    assert kpis.daily_sales(o, days=0, as_of=date(2024, 1, 3)).count() < kpis.daily_sales(o, as_of=date(2024, 1, 3)).count()


def test_inactive_customers(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_active boolean")
    assert [r["id"] for r in listings.filter_customers(users, "inactive").collect()] == [2]
    assert listings.filter_customers(users, "any").count() == 3
