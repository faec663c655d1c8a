"""Exports read back row by row; snapshots are versioned; documents spread and
come back in order."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thali.operators import changes, documents
from thali.plans.q_changes import payment_change_batch
from thali.sinks import exports
from thali.sources.tables import load_tables

AS_OF = date(2001, 7, 31)


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SF_SMALL)


def _texts(df):
    """Rows as CSV writes them: everything text, NULL and empty apart."""
    return sorted((tuple(None if v is None else str(v) for v in r) for r in df.select(
        *[F.col(c).cast("string").alias(c) for c in df.columns]).collect()), key=str)


def _read(spark, path, frame):
    # on disk an empty text is quoted and NULL is nothing; a mark keeps them apart when read
    back = spark.read.option("header", True).option("emptyValue", "<empty>").option("multiLine", True).csv(path)
    assert back.columns == frame.columns
    return _texts(back.replace("<empty>", ""))


def _same(spark, path, frame):
    written = frame.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(c) if kind.startswith("timestamp") else F.col(c)
                             for c, kind in frame.dtypes])
    assert _read(spark, path, written) == _texts(written)


def test_orders_export(spark, t, scratch):
    how = {"status": "pending"}
    path = exports.export_orders(t["orders"], t["order_items"], t["payments"], os.path.join(scratch, "o"), **how)
    _same(spark, path, exports.export_orders_frame(t["orders"], t["order_items"], t["payments"], **how))


def test_selected_orders_export(spark, t, scratch):
    ids = t["orders"].where("order_id % 7 = 0").select("order_id")
    path = exports.export_selected_orders(t["orders"], ids, os.path.join(scratch, "s"))
    _same(spark, path, exports.export_selected_frame(t["orders"], ids))


def test_customers_export(spark, t, scratch):
    path = exports.export_customers(t["users"], t["orders"], os.path.join(scratch, "c"))
    _same(spark, path, exports.export_customers_frame(t["users"], t["orders"]))


@pytest.mark.parametrize("period", ["all", "week", "month"])
def test_statistics_export(spark, t, scratch, period):
    paths = exports.export_statistics(t["orders"], t["order_items"], t["payments"], period, AS_OF, os.path.join(scratch, period))
    sections = exports.statistics_sections(t["orders"], t["order_items"], t["payments"], period, AS_OF)
    assert set(paths) == set(sections) == {"kpis", "daily", "categories", "payment_methods"}
    for name, path in paths.items():
        _same(spark, path, sections[name])


def test_null_and_empty_stay_apart_in_csv(spark, scratch):
    frame = spark.createDataFrame([("", None, 'a "b", c'), (None, "", "x\ny")], "a string, b string, c string")
    exports._csv(frame, os.path.join(scratch, "e"))
    assert _read(spark, os.path.join(scratch, "e"), frame) == _texts(frame)


def test_activity_log_has_each_batch_once(spark, t, scratch):
    act = changes.apply_payment_changes(t["payments"], t["orders"], payment_change_batch({"orders": t["orders"]})).history
    other = act.limit(3)
    path = os.path.join(scratch, "activity")
    for rows, batch in ((act, "2024-01-30"), (other, "2024-01-31"), (act, "2024-01-30")):  # the first is run again
        exports.append_activity(rows, path, batch)
    assert exports.read_activity(spark, path).count() == act.count() + 3
    assert _texts(exports.read_activity(spark, os.path.join(path, "batch=2024-01-30"))) == _texts(act)
    with pytest.raises(ValueError):
        exports.append_activity(act, path, "../elsewhere")


def test_snapshot_versions(spark, t, scratch):
    base = os.path.join(scratch, "orders")
    p1 = exports.write_snapshot(t["orders"], base, 1)
    p2 = exports.write_snapshot(t["orders"].withColumn("m", F.date_format("order_date", "yyyy-MM")), base, 2, "m")
    assert _texts(spark.read.parquet(p1)) == _texts(spark.read.parquet(p2).drop("m").select(*t["orders"].columns))


def test_a_large_order_spreads_over_tasks_in_order(spark, t):
    big = spark.range(100_000).select(
        F.lit(1).cast("long").alias("order_id"), (F.lit(100_000) - F.col("id")).cast("int").alias("line_no"), F.lit("menu").alias("item_type"),
        F.col("id").alias("item_id"), F.lit("x").alias("item_name"), F.lit("").alias("item_photo"), F.lit(1).alias("quantity"),
        F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("price"), F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("total"))
    docs = documents.order_documents(t["orders"], big, t["payments"], t["users"], t["addresses"], t["services"], t["menu"])
    out = documents.in_order(docs, documents.ORDER_SORT, 16)
    rows = out.where("order_id = 1 and section = 'line'").select("line_no", F.spark_partition_id().alias("p"))
    per_task = rows.groupBy("p").count().collect()
    assert len(per_task) >= 8 and max(r["count"] for r in per_task) < 30_000
    assert [r["line_no"] for r in rows.collect()] == list(range(1, 100_001))


def test_nested_documents_of_requested_ids(spark, t):
    docs = documents.order_documents(*(t[x] for x in ("orders", "order_items", "payments", "users", "addresses", "services", "menu")))
    ids = [r["order_id"] for r in t["orders"].orderBy("order_id").limit(5).collect()]
    got = documents.nested(docs, "order_id", ids, documents.ORDER_SORT).collect()
    lines = {r["order_id"]: [x["line_no"] for x in r["rows"]] for r in got if r["section"] == "line"}
    for i, numbers in lines.items():
        assert numbers == sorted(numbers) and len(numbers) == t["order_items"].where(F.col("order_id") == i).count()
    assert sum(len(r["rows"]) for r in got if r["section"] == "header") == 5
    with pytest.raises(ValueError):
        documents.nested(docs, "order_id", range(documents.MOST_IDS + 1), documents.ORDER_SORT)


def test_chart_points(spark, t):
    points = documents.chart_series(t["orders"], t["order_items"], t["payments"], AS_OF).collect()
    charts = {r["chart"] for r in points}
    assert charts == {"daily_orders", "status_distribution", "top_items", "payment_methods"}
    assert sum(r["value"] for r in points if r["chart"] == "status_distribution") == t["orders"].count()


def test_chart_order_holds_for_any_amount(spark):
    big = [(i, "completed", mode, Decimal(amount)) for i, (mode, amount) in enumerate(
        [("A", "9999999999999999.01"), ("B", "9999999999999990.00"), ("C", "0.02"), ("D", "0.01")])]
    payments = spark.createDataFrame(big, "payment_id long, payment_status string, payment_mode string, amount decimal(20,2)")
    orders = spark.createDataFrame([], "order_id long, user_id long, status string, total_amount decimal(18,2), order_date timestamp_ntz")
    items = spark.createDataFrame([], "item_name string, quantity int")
    points = documents.chart_series(orders, items, payments, datetime(2024, 1, 1).date()).where("chart = 'payment_methods'")
    assert [r["label"] for r in points.orderBy("place", "label").collect()] == ["A", "B", "C", "D"]
