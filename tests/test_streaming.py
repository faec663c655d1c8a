"""Streams end in the state the batch form computes, also across a restart and
under a session zone with daylight saving (SURVEY §5, invariants)."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thali.operators import changes
from thali.session import checkpoint_dir
from thali.sources.tables import load_tables, read_raw
from thali.streaming import live


def _rows(df, key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r[:key]))


def _drain(query):
    query.processAllAvailable()
    query.stop()


@pytest.fixture(params=["UTC", "America/Los_Angeles"])
def zone(spark, request):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", old)


def test_live_counters_resume_without_loss_or_repeat(spark, scratch, zone):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"]
    src, out, ck = (os.path.join(scratch, x) for x in ("feed", "out", "ck"))
    cut = F.lit("1998-06-01 12:00:00").cast("timestamp_ntz")
    for part in (0, 1):  # the later orders arrive after the query was stopped
        live.order_feed(orders.where((F.col("order_date") >= cut).cast("int") == part)).write.parquet(os.path.join(src, f"p{part}"))
        _drain(live.start_live_counters(spark, src + "/*", out, name="t_live", checkpoint=ck))
    _drain(live.start_live_counters(spark, src + "/*", out, name="t_live", checkpoint=ck))
    assert _rows(live.live_totals(spark, out), 1) == _rows(live.live_counters(orders), 1)


def test_live_counters_take_a_cancelled_order_back(spark, scratch):
    d = datetime
    rows = [(1, 10, "100.50", "pending", d(2024, 1, 1, 10)), (2, 11, "20.00", "pending", d(2024, 1, 1, 11)),
            (3, 11, "7.25", "cancelled", d(2024, 1, 1, 11, 30)), (4, 12, "5.00", None, d(2024, 1, 1, 11, 40)), (5, 12, None, "pending", None)]
    orders = spark.createDataFrame([(i, u, s, at) for i, u, _, s, at in rows], "order_id long, user_id long, status string, order_date timestamp_ntz")
    amounts = spark.createDataFrame([(i, a) for i, _, a, _, _ in rows], "order_id long, amount string")
    orders = orders.join(amounts, "order_id").select("*", F.col("amount").cast("decimal(18,2)").alias("total_amount"), F.lit("").alias("notes")).drop("amount")
    asked = spark.createDataFrame([(1, "cancelled", None, "x", 1), (3, "processing", None, "x", 2), (1, "pending", None, "x", 3), (1, "cancelled", None, "x", 4),
                                   (4, "completed", None, "x", 5)], "order_id long, new_status string, notes string, changed_by string, seq long")
    result = changes.apply_status_changes(orders, asked)
    history = result.history.withColumn("changed_at", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("seq").cast("int")))
    feed = live.order_feed(orders, history)
    src, out, ck = (os.path.join(scratch, x) for x in ("feed", "out", "ck"))
    steps = [feed.where("is_new"), feed.where("is_new or seq <= 2"), feed.where("seq >= 2")]  # rows sent again, and a restart for each
    for i, step in enumerate(steps):
        step.coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        _drain(live.start_live_counters(spark, src + "/*", out, name="t_back", checkpoint=ck))
    assert _rows(live.live_totals(spark, out), 1) == _rows(live.live_counters(result.snapshot), 1)
    assert _rows(live.live_totals(spark, out), 1)[0][1:] == (4, 32.25)


def test_update_counts_append_closed_events(spark, scratch):
    events = read_raw(spark, SF_SMALL, "events")
    src, out = os.path.join(scratch, "events"), os.path.join(scratch, "out")
    events.write.parquet(src)
    _drain(live.start_update_counts(spark, src, events.schema, out, name="t_upd", checkpoint=os.path.join(scratch, "ck"), trigger=None))
    got = _rows(live.update_totals(spark, out), 1)
    cutoff = events.agg(F.max("ts")).first()[0] - timedelta(hours=2)  # closed: an hour past the event's session
    want = [r for r in _rows(live.update_counts(events.where(F.col("ts") <= cutoff)), 1)]
    assert got == want and len(got) > 0


def test_update_counts_of_repeats_out_of_order(spark, scratch):
    at = datetime(2024, 1, 1, 12)
    minute = lambda m: at + timedelta(minutes=m)
    schema = "event_id long, ts timestamp_ntz, event_type string"
    first = [(1, minute(20), "purchase"), (2, minute(10), "purchase"), (3, minute(5), "view")]
    second = [(1, minute(2), "purchase"), (2, minute(40), "purchase"), (4, minute(30), "purchase")]  # event 1 earlier, event 2 later
    last = [(9, minute(600), "purchase")]
    src, out, ck = (os.path.join(scratch, x) for x in ("ev", "out", "ck"))
    for i, rows in enumerate((first, second, last, [(8, minute(601), "view")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        _drain(live.start_update_counts(spark, src + "/*", spark.createDataFrame([], schema).schema, out, name="t_rep", checkpoint=ck, trigger=None))
    want = live.update_counts(spark.createDataFrame(first + second, schema))
    assert _rows(live.update_totals(spark, out), 1) == _rows(want, 1)


def test_map_view_counts_with_repeat_and_late(spark, scratch):
    t = load_tables(spark, SF_SMALL, ("addresses",))
    events = read_raw(spark, SF_SMALL, "events")
    views = live.map_view_events(events, t["addresses"])
    src, out, ck = (os.path.join(scratch, x) for x in ("views", "out", "ck"))
    views.coalesce(1).write.json(os.path.join(src, "a"))
    q = live.start_map_view_counts(spark, os.path.join(src, "*"), out, name="t_map", checkpoint=ck)
    q.processAllAvailable()
    # a repeated event inside the watermark (counted twice: events carry no id)
    recent = (events.agg(F.max("ts")).first()[0] - timedelta(minutes=10)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    first = spark.createDataFrame([("1.5", "2.5", "X", recent, "ua", "r")] * 2, live.MAP_VIEW_SCHEMA)
    late = spark.createDataFrame([("1.5", "2.5", "X", "2020-01-01T00:00:00.000Z", "ua", "r")], live.MAP_VIEW_SCHEMA)
    first.unionByName(late).coalesce(1).write.json(os.path.join(src, "b"))
    _drain(q)
    keys = ["hour_start", "latitude", "longitude"]
    want = live.map_view_counts(views.unionByName(first))
    assert _rows(live.latest(spark, out, keys).select(*want.columns), 3) == _rows(want, 3)


TIMES = [datetime(2024, 11, 3, 8, 30), datetime(2024, 11, 3, 9, 30), datetime(2024, 3, 10, 2, 30, 0, 123000), datetime(2024, 3, 10, 9, 59, 59, 999999)]


def test_instants_and_texts_do_not_depend_on_the_zone(spark, zone):
    df = spark.createDataFrame([(t,) for t in TIMES], "ts timestamp_ntz")
    got = df.select("ts", F.unix_micros(live.to_instant("ts")).alias("us"), live.to_utc_ntz(live.to_instant("ts")).alias("back"),
                    live._iso_text(F.col("ts")).alias("text")).collect()
    for r in got:
        assert r["us"] == (r["ts"] - datetime(1970, 1, 1)) // timedelta(microseconds=1) and r["back"] == r["ts"]
        assert r["text"] == r["ts"].isoformat(timespec="milliseconds") + "Z"


def test_update_counts_keep_the_hours_of_an_autumn_change_apart(spark, zone):
    rows = [(1, TIMES[0]), (2, TIMES[1]), (3, TIMES[1]), (3, TIMES[0])]  # event 3 twice, earliest last
    for order in (rows, rows[::-1]):
        events = spark.createDataFrame([(i, t, "purchase") for i, t in order], "event_id long, ts timestamp_ntz, event_type string")
        assert _rows(live.update_counts(events), 1) == [(TIMES[0], 2), (TIMES[1], 1)]


def test_a_session_without_a_shared_folder_is_refused():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        checkpoint_dir(Bare)
