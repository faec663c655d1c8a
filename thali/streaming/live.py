"""Structured Streaming jobs for the polled / posted flows.

Each job is a transform that works on a streaming *or* a static frame, so
the batch form is the test oracle of the stream, plus a ``start_*`` helper
that wires ``readStream`` -> transform -> ``writeStream`` with a checkpoint
in the shared folder (``spark.checkpoint.dir``), so a restarted query
resumes from its offsets and state after executor or driver loss.

Event time: stored values are UTC ``TIMESTAMP_NTZ``; watermarks need
``TIMESTAMP``, so ``to_instant`` counts microseconds from the wall-clock
fields.  No step goes through local time, so both hours of an autumn DST
change stay apart under any session time zone.  Late data: dropped after a one
hour watermark.

Results are durable: every micro-batch is written by ``foreachBatch`` to its
own folder ``batch=N``, overwritten if the batch runs again, so a restart from
the checkpoint loses and repeats nothing.  X1 and X2 write what a micro-batch
adds, and ``live_totals`` and ``update_totals`` sum that; X3 writes changed rows,
and ``latest`` reads the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from thali.functions.numbers import money_sum
from thali.session import checkpoint_dir

WATERMARK = "1 hour"
# IST day windows start at 18:30 UTC; poll interval; map-view bucket.
IST_DAY_OFFSET = "18 hours 30 minutes"
IST_SECONDS = 19800
POLL = "30 seconds"
MAP_BUCKET = "1 hour"
# Fixed schema of the browser's map-view event (all texts, as posted).
MAP_VIEW_SCHEMA = ("latitude string, longitude string, address string, timestamp string, "
                   "userAgent string, referrer string")


_DAY = 86_400_000_000


def to_instant(col: Column | str) -> Column:
    """UTC ``TIMESTAMP_NTZ`` -> ``TIMESTAMP`` (the same instant)."""
    c = F.col(col) if isinstance(col, str) else col
    seconds = F.extract(F.lit("SECOND"), c)
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (seconds * 1_000_000).cast("long")
    return F.timestamp_micros(F.unix_date(c.cast("date")).cast("long") * _DAY + clock)


def to_utc_ntz(col: Column) -> Column:
    """``TIMESTAMP`` -> its UTC wall clock as ``TIMESTAMP_NTZ``."""
    micros = F.unix_micros(col)
    days = F.floor(micros / _DAY).cast("int")
    seconds = ((micros - days.cast("long") * _DAY).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def _watermarked(df: DataFrame, col: str) -> DataFrame:
    return df.withWatermark(col, WATERMARK) if df.isStreaming else df


def live_counters(orders: DataFrame) -> DataFrame:
    """X1 of a table: orders and non-cancelled revenue per IST day (tumbling
    1-day windows offset to 18:30 UTC).  The stream reaches the same by signed
    changes (``order_feed``, ``day_deltas``)."""
    ev = _watermarked(orders.select(to_instant("order_date").alias("et"), "status", "total_amount")
                      .where(F.col("et").isNotNull()), "et")
    nc = F.col("status") != "cancelled"
    agg = ev.groupBy(F.window("et", "1 day", "1 day", IST_DAY_OFFSET).alias("w")).agg(
        F.count(F.lit(1)).alias("orders"),
        money_sum(F.when(nc, F.col("total_amount"))).alias("revenue"))
    day = F.date_add(F.lit("1970-01-01").cast("date"),
                     F.floor((F.unix_seconds(F.col("w.start")) + IST_SECONDS) / 86400).cast("int"))
    return agg.select(day.alias("day"), "orders", "revenue")


FEED_SCHEMA = ("order_id long, seq long, order_date timestamp_ntz, total_amount decimal(18,2), old_status string, "
               "new_status string, is_new boolean, changed_at timestamp_ntz")


def order_feed(orders: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The change feed of the live counters: a row for each new order (``seq``
    NULL) and one for each status change of C1's history, with the order's date
    and amount.  A change takes back what its order counted before."""
    own = orders.select("order_id", F.lit(None).cast("long").alias("seq"), "order_date", "total_amount",
                        F.lit(None).cast("string").alias("old_status"), F.col("status").alias("new_status"),
                        F.lit(True).alias("is_new"), F.col("order_date").alias("changed_at"))
    if history is None:
        return own
    at = F.col("changed_at") if "changed_at" in history.columns else F.col("order_date")
    changed = history.join(orders.select("order_id", "order_date", "total_amount"), "order_id").select(
        "order_id", "seq", "order_date", "total_amount", "old_status", "new_status", F.lit(False).alias("is_new"), at.alias("changed_at"))
    return own.unionByName(changed)


def _counted(status: Column) -> Column:
    return F.when(status != "cancelled", 1).otherwise(0)


def day_deltas(feed: DataFrame) -> DataFrame:
    """Signed changes of X1 per IST day: orders, and revenue as an exact decimal.
    They add up over any split of the feed."""
    gained = _counted(F.col("new_status")) - F.when(F.col("is_new"), 0).otherwise(_counted(F.col("old_status")))
    seconds = F.floor(F.unix_micros(to_instant("order_date")) / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + IST_SECONDS) / 86400).cast("int"))
    amount = F.coalesce(F.col("total_amount"), F.lit(0)).cast("decimal(18,2)")
    rows = feed.where(F.col("order_date").isNotNull()).select(day.alias("day"), F.col("is_new").cast("int").alias("_one"), (amount * gained).alias("_gain"))
    return rows.groupBy("day").agg(F.sum("_one").alias("orders"), F.sum("_gain").alias("revenue"))


def day_totals(deltas: DataFrame) -> DataFrame:
    """X1 from signed changes, as ``live_counters`` shows it."""
    return deltas.groupBy("day").agg(F.sum("orders").cast("long").alias("orders"), F.sum("revenue").cast("double").alias("revenue"))


def update_counts(events: DataFrame) -> DataFrame:
    """New order (purchase) events per 30-second poll window, each event
    id counted once, at its earliest time."""
    ev = _purchases(events).groupBy("event_id").agg(F.min("et").alias("et"))
    return _polled(ev)


def _purchases(events: DataFrame) -> DataFrame:
    return (events.where(F.col("event_type") == "purchase")
            .select("event_id", to_instant("ts").alias("et")).where(F.col("et").isNotNull()))


def first_times(events: DataFrame) -> DataFrame:
    """Each purchase event of a stream once, at its earliest time: its repeats,
    which may come in any order, meet in a session that closes when the watermark
    is an hour past the last of them."""
    ev = _watermarked(_purchases(events), "et")
    one = ev.groupBy("event_id", F.session_window("et", WATERMARK)).agg(F.min("et").alias("first"))
    return one.select("event_id", F.col("first").alias("et"))


def _polled(ev: DataFrame) -> DataFrame:
    agg = ev.groupBy(F.window("et", POLL).alias("w")).agg(F.count(F.lit(1)).alias("new_orders"))
    return agg.select(to_utc_ntz(F.col("w.start")).alias("window_start"), "new_orders")


def _iso_text(c: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` from the wall-clock fields (``date_format``
    would move times in the session zone's DST gap)."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    millis = F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("int") % 1000
    return F.concat(c.cast("date").cast("string"), F.lit("T"), two(F.hour(c)), F.lit(":"), two(F.minute(c)), F.lit(":"),
                    two(F.second(c)), F.lit("."), F.lpad(millis.cast("string"), 3, "0"), F.lit("Z"))


def map_view_events(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """Map-view events as the browser posts them, derived from ``view``
    events and the viewer's default address (texts, ISO ``...Z`` time)."""
    a = addresses.where(F.col("is_default")).select(
        F.col("user_id").alias("_uid"), "latitude", "longitude",
        F.concat_ws(", ", "address_line1", "city").alias("address"))
    v = events.where(F.col("event_type") == "view")
    return v.join(a, v["user_id"] == a["_uid"]).select(
        F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        "address",
        _iso_text(F.col("ts")).alias("timestamp"),
        F.lit("Mozilla/5.0").alias("userAgent"), F.lit("/orders").alias("referrer"))


def map_view_counts(views: DataFrame) -> DataFrame:
    """Map views per location (lat, lon) per hour.  Events carry no id,
    so repeats are counted."""
    ntz = F.to_timestamp_ntz(F.regexp_replace("timestamp", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    ev = views.select(F.col("latitude").try_cast("double").alias("lat"),
                      F.col("longitude").try_cast("double").alias("lon"),
                      ntz.alias("_ntz"))
    ev = ev.select("lat", "lon", to_instant("_ntz").alias("et")).where(F.col("et").isNotNull())
    ev = _watermarked(ev, "et")
    agg = ev.groupBy(F.window("et", MAP_BUCKET).alias("w"), "lat", "lon").agg(F.count(F.lit(1)).alias("views"))
    return agg.select(to_utc_ntz(F.col("w.start")).alias("hour_start"),
                      F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "views")


# --- stream wiring -------------------------------------------------------------

def _run(spark: SparkSession, out: DataFrame, name: str, path: str, mode: str, checkpoint: str | None,
         trigger: str | None, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    def keep(rows: DataFrame, batch: int) -> None:
        reduce(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    place = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = out.writeStream.outputMode(mode).queryName(name).foreachBatch(keep).option("checkpointLocation", place)
    return (w.trigger(processingTime=trigger) if trigger else w).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that a stream has written to ``path``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")


def _source(spark: SparkSession, schema, kind: str, folder: str) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def start_live_counters(spark: SparkSession, feed_dir: str, path: str, name: str = "live_counters",
                        checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Run X1 over parquet files of the change feed arriving in ``feed_dir``.
    A row that is sent again within the watermark counts once; the signed
    changes of each micro-batch go to ``path``."""
    feed = _source(spark, FEED_SCHEMA, "parquet", feed_dir)
    feed = feed.withColumn("et", F.coalesce(to_instant("changed_at"), F.timestamp_micros(F.lit(0))))
    feed = feed.withWatermark("et", WATERMARK).dropDuplicatesWithinWatermark(["order_id", "seq", "is_new"])
    return _run(spark, feed, name, path, "append", checkpoint, trigger, day_deltas)


def live_totals(spark: SparkSession, path: str) -> DataFrame:
    """The counters that a run of X1 has reached."""
    return day_totals(spark.read.parquet(path))


def start_update_counts(spark: SparkSession, events_dir: str, schema, path: str, name: str = "update_counts",
                        checkpoint: str | None = None, trigger: str | None = POLL) -> StreamingQuery:
    """Run X2 over parquet event files; each micro-batch adds the events that
    are closed to the windows of ``path``."""
    return _run(spark, first_times(_source(spark, schema, "parquet", events_dir)), name, path, "append", checkpoint, trigger, _polled)


def update_totals(spark: SparkSession, path: str) -> DataFrame:
    """The windows that a run of X2 has counted."""
    return spark.read.parquet(path).groupBy("window_start").agg(F.sum("new_orders").alias("new_orders"))


def start_map_view_counts(spark: SparkSession, json_dir: str, path: str, name: str = "map_view_counts",
                          checkpoint: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """Run X3 over posted JSON map-view events; changed hours go to ``path``."""
    return _run(spark, map_view_counts(_source(spark, MAP_VIEW_SCHEMA, "json", json_dir)), name, path, "update", checkpoint, trigger)
