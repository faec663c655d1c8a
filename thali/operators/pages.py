"""Listings laid out for paging (O1 on any page).

A page by offset sorts everything before it.  Here the listing is sorted once
into ranges of about equal size, stored by range; a directory has each range's
number of rows.  Page n then reads the one or two ranges that hold its rows,
and of those the rows at their places, which lie together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from thali.operators.listings import PAGE_SIZE

_PLACE = (1 << 33) - 1  # of a row within its range


class PagedListing:
    """A sorted listing in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def lay_out(self, listing: DataFrame, sort: list[Column], ranges: int | None = None) -> PagedListing:
        """Write ``listing`` in the order ``sort``.  Without ``ranges`` their number
        follows the size."""
        laid = listing.repartitionByRange(ranges, *sort) if ranges else listing.repartitionByRange(*sort)
        laid = laid.sortWithinPartitions(*sort).withColumns({
            "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)), "_range": F.spark_partition_id()})
        laid.write.mode("overwrite").partitionBy("_range").parquet(f"{self.path}/rows")
        listing.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema")
        counts = self._rows().groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory")
        return self

    def _rows(self, ranges: list[int] | None = None) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema.add("_place", LongType()).add("_range", IntegerType())
        base = f"{self.path}/rows"
        paths = [base] if ranges is None else [f"{base}/_range={k}" for k in ranges]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def directory(self) -> list[tuple[int, int, int]]:
        """(range, first row, rows), in order: a row a range."""
        found = sorted((r["_range"], r["n"]) for r in self.spark.read.schema("_range int, n long").parquet(f"{self.path}/directory").collect())
        out, first = [], 0
        for number, n in found:
            out.append((number, first, n))
            first += n
        return out

    def counts(self) -> tuple[int, int]:
        """Rows and pages."""
        total = sum(n for _, _, n in self.directory())
        return total, -(-total // PAGE_SIZE)

    def page(self, page: int, sort: list[Column]) -> DataFrame:
        """Page ``page``, from 1, of ``PAGE_SIZE`` rows in the order ``sort``."""
        if page < 1:
            raise ValueError("page must be >= 1")
        low = (page - 1) * PAGE_SIZE
        high = low + PAGE_SIZE
        # two ranges at most, unless ranges are shorter than a page
        of = [(number, first) for number, first, n in self.directory() if first < high and first + n > low]
        rows, wanted = self._rows([number for number, _ in of]) if of else self._rows(), F.lit(False)
        for number, first in of:
            wanted = wanted | ((F.col("_range") == number) & F.col("_place").between(low - first, high - first - 1))
        return rows.where(wanted).orderBy(*sort).drop("_place", "_range")
