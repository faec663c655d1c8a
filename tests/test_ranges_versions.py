"""Keys of any size in sorted ranges; tables in parts and versions."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thali.operators import changes, listings
from thali.operators.ranges import in_ranges, looked_back, numbered
from thali.sinks.versions import PartedTable, hash_part, month_part
from thali.sources.tables import load_tables


@pytest.fixture()
def many_ranges(spark):
    """Ranges stay as many as set, as tables of real size have them."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def hot_addresses(spark, n):
    """One customer with n addresses, few dates, nulls; some others beside."""
    hot = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("address_id"))
    rest = spark.range(50).select((F.col("id") % 7 + 2).alias("user_id"), (F.col("id") + n).alias("address_id"))
    none = spark.range(5).select(F.lit(None).cast("long").alias("user_id"), (F.col("id") + n + 50).alias("address_id"))
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    return hot.union(rest).union(none).select(
        "user_id", "address_id", F.when(F.col("address_id") % 3 > 0, F.col("address_id") % 2 == 0).alias("is_default"),
        F.when(F.col("address_id") % 5 > 0, at + F.make_dt_interval(days=(F.col("address_id") % 4).cast("int"))).alias("created_at"),
        *[F.lit("x").alias(c) for c in ("full_name", "phone", "address_line1", "address_line2", "landmark", "city", "state", "pincode")],
        *[F.lit(1.0).alias(c) for c in ("latitude", "longitude")])


def test_numbers_equal_the_windows_and_a_hot_key_spreads(spark, many_ranges):
    rows = hot_addresses(spark, 100_000)
    order = listings._address_order(rows)
    laid = in_ranges(rows, "user_id", order, "t")
    per_range = [r["n"] for r in laid.where("user_id = 1").groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_range) >= 6 and max(per_range) < 40_000
    w = listings.Window.partitionBy("user_id").orderBy(*order)
    want = rows.select("user_id", "address_id", F.row_number().over(w).alias("want"))
    both = numbered(laid, "user_id", "rank").select("user_id", "address_id", "rank").join(want, "address_id")
    assert both.where("rank <> want").count() == 0 and both.count() == 100_055


def test_looking_back_over_ranges(spark, many_ranges):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(F.lit(1)).alias("key"),
                                      F.xxhash64("id").alias("at"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("value"))
    laid = in_ranges(rows, "key", [F.col("at")], "t")
    assert laid.where("key = 1").select("_range").distinct().count() >= 6
    w = listings.Window.partitionBy("key").orderBy("at")
    want = rows.select("at", F.lag("value").over(w).alias("want"))
    got = looked_back(laid, "key", "value", "before").join(want, "at")
    assert got.where("not before <=> want").count() == 0 and got.count() == 20_000


def test_ranges_of_an_empty_table(spark):
    none = spark.createDataFrame([], "key long, at long, value string")
    assert numbered(in_ranges(none, "key", [F.col("at")], "t"), "key", "n").count() == 0
    assert looked_back(in_ranges(none, "key", [F.col("at")], "t"), "key", "value", "b").count() == 0


def test_history_of_a_hot_order(spark, many_ranges):
    orders = spark.createDataFrame([(1, "pending", ""), (2, "pending", "")], "order_id long, status string, notes string")
    status = F.element_at(F.array(*[F.lit(s) for s in changes.ORDER_STATUSES]), (F.col("id") % 5 + 1).cast("int"))
    asked = spark.range(10_000).select(F.lit(1).cast("long").alias("order_id"), status.alias("new_status"), F.lit(None).cast("string").alias("notes"),
                                       F.lit("x").alias("changed_by"), F.floor(F.col("id") / 2).alias("seq"))
    rows = sorted(changes.apply_status_changes(orders, asked).history.collect(), key=lambda r: (r["seq"], r["new_status"]))
    assert [r["old_status"] for r in rows] == ["pending"] + [r["new_status"] for r in rows][:-1]


# tables in parts

def texts(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_a_batch_of_one_month_rewrites_that_month(spark, scratch):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"]
    table = PartedTable(spark, os.path.join(scratch, "orders"), "order_date", month_part)
    table.create(orders)
    before = table.parts()
    assert len(before) > 50 and texts(table.read().drop("part")) == texts(orders)
    month = orders.where("order_date >= timestamp_ntz'1997-03-01' and order_date < timestamp_ntz'1997-04-01'")
    for batch in (month.select("order_id"), month.select("order_id", "order_date")):  # with and without a look into the table
        version = table.version()
        asked = changes.bulk_status_changes(batch, "delivered", notes="n")
        read = []

        def change(rows):
            read.extend(rows.inputFiles())
            return changes.apply_status_changes(rows, asked).snapshot

        assert table.update(batch, "order_id", change) == version + 1
        after = table.parts()
        assert {p for p in before if after[p] != before[p]} == {199703} and set(after) == set(before)
        assert read and all("part=199703" in f for f in read)
        written = os.listdir(os.path.join(scratch, "orders", "data", f"written={after[199703]}"))
        assert [x for x in written if x.startswith("part=")] == ["part=199703"]
    want = changes.apply_status_changes(orders, changes.bulk_status_changes(month, "delivered", notes="n")).snapshot
    assert texts(table.read().drop("part")) == texts(want)
    assert texts(table.read(0).drop("part")) == texts(orders)  # earlier versions stay


def test_deleting_a_month_and_an_empty_batch(spark, scratch):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"]
    table = PartedTable(spark, os.path.join(scratch, "orders"), "order_date", month_part)
    table.create(orders)
    month = orders.where("order_date >= timestamp_ntz'1997-03-01' and order_date < timestamp_ntz'1997-04-01'").select("order_id")
    table.update(month, "order_id", lambda rows: rows.join(month, "order_id", "left_anti"))
    assert 199703 not in table.parts() and table.read().count() == orders.count() - month.count()
    before = table.parts()
    table.update(month.limit(0), "order_id", lambda rows: rows)
    assert table.parts() == before and table.version() == 2


def test_a_failed_update_leaves_the_version_and_may_run_again(spark, scratch):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"].limit(200).cache()
    table = PartedTable(spark, os.path.join(scratch, "orders"), "order_id", hash_part(4))
    table.create(orders)
    with pytest.raises(ValueError):  # rows that leave their part
        table.update(orders.limit(1), "order_id", lambda rows: rows.withColumn("order_id", F.col("order_id") + 1))
    assert table.version() == 0 and texts(table.read().drop("part")) == texts(orders)
    table.update(orders, "order_id", lambda rows: rows)
    assert table.version() == 1 and texts(table.read().drop("part")) == texts(orders)


def test_an_empty_table_in_parts(spark, scratch):
    orders = load_tables(spark, SF_SMALL, ("orders",))["orders"].limit(0)
    table = PartedTable(spark, os.path.join(scratch, "orders"), "order_date", month_part)
    table.create(orders)
    assert table.read().count() == 0 and table.read().drop("part").columns == orders.columns
