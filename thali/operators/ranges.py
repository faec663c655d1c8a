"""Numbering and looking back over sorted ranges, for keys of any size.

A window over a key sorts all rows of the key in one task.  Here the rows are
sorted by (key, order) over ranges of about equal size, so a key with very
many rows lies in several ranges.  Windows run within (key, range); what a
range needs from the ranges before it, a count or a last value per key, is a
small table: a range can have only one key that began in an earlier one.

The ranges are written to the shared folder first, since range bounds are
sampled and a second evaluation could draw them elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.session import stored


def in_ranges(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` sorted by ``key`` and ``order``, with ``_range``, the number of
    the range, and ``_at``, which grows with the place."""
    laid = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    return stored(laid.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def _from_earlier(laid: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``laid`` left-joined with ``parts`` (key, _range, _earlier), at most one
    row a range, hence broadcast."""
    one = parts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), "_earlier")
    return laid.join(F.broadcast(one), laid[key].eqNullSafe(F.col("_key")) & (laid["_range"] == F.col("_of")), "left").drop("_key", "_of")


def numbered(laid: DataFrame, key: str, name: str) -> DataFrame:
    """Column ``name``: the place of a row among those of its key, from 1."""
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_earlier", F.sum("_n").over(before))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy("_at"))
    out = _from_earlier(laid, parts.where("_earlier is not null"), key).withColumn(name, place + F.coalesce("_earlier", F.lit(0)))
    return out.drop("_earlier", "_range", "_at")


def looked_back(laid: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Column ``name``: ``value`` of the row before, of the same key (NULL for
    the first)."""
    ranges = Window.partitionBy(key).orderBy("_range")
    parts = laid.groupBy(key, "_range").agg(F.struct(F.max_by(value, "_at").alias("last")).alias("_last"))
    parts = parts.withColumn("_earlier", F.lag("_last").over(ranges)).where("_earlier is not null")
    rows = Window.partitionBy(key, "_range").orderBy("_at")
    back = F.lag(F.struct(F.col(value).alias("last"))).over(rows)
    out = _from_earlier(laid, parts, key).withColumn("_back", F.coalesce(back, "_earlier"))
    return out.withColumn(name, F.col("_back.last")).drop("_earlier", "_back", "_range", "_at")
