"""Tables kept in parts and versions, so a batch of changes costs what it
touches (SURVEY C1-C4).

A table is a folder: ``data/written=W/part=P`` holds the rows of part P as
written by W, ``versions/version=N`` lists for each part which W is current.
A new version rewrites the parts that a batch touches and lists the others as
they were.  The list is written last and names the new files, so a reader sees
either version whole, a run that fails leaves no trace in the table, and it may
be run again.

The part of a row must not change with its values: orders go by the month of
their date (``month_part``), payments, whose dates change, by a hash of the order
(``hash_part``).  The list of parts passes the driver: a row a month, or a row a
hash part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_LIST = "part int, written string"


def month_part(column: Column) -> Column:
    """Year and month as one number, 0 without a date."""
    return F.coalesce(F.year(column) * 100 + F.month(column), F.lit(0)).cast("int")


def hash_part(parts: int) -> Callable[[Column], Column]:
    """One of ``parts`` by a key's hash."""
    return lambda key: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class PartedTable:
    """A table in parts at ``base``; ``part`` makes a row's part of ``column``."""

    def __init__(self, spark: SparkSession, base: str, column: str, part: Callable[[Column], Column]):
        self.spark, self.base, self.column, self.part = spark, base.rstrip("/"), column, part(F.col(column))

    # versions

    def version(self) -> int:
        """The newest version."""
        return self.spark.read.schema(f"{_LIST}, version int").parquet(f"{self.base}/versions").agg(F.max("version")).first()[0]

    def parts(self, version: int | None = None) -> dict[int, str]:
        """Who wrote each part of a version."""
        at = self.version() if version is None else version
        listed = self.spark.read.schema(_LIST).parquet(f"{self.base}/versions/version={at}")
        return {r["part"]: r["written"] for r in listed.where("part is not null").collect()}

    def _list(self, version: int, parts: dict[int, str]) -> None:
        rows = [(None, None), *sorted(parts.items())]  # an empty table has a list too
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/versions/version={version}")

    # rows

    def _schema(self):
        return self.spark.read.parquet(f"{self.base}/schema").schema

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        """Write rows by part; the name of the writing and the parts it has.
        Rows of a part come from several tasks, so a part of any size is spread."""
        name = uuid.uuid4().hex
        path = f"{self.base}/data/written={name}"
        rows.withColumn("part", self.part).write.partitionBy("part").parquet(path)
        there = self.spark.read.schema("part int").option("basePath", path).parquet(path).distinct()
        return name, {r["part"] for r in there.collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts, with ``part``."""
        parts = {p: w for p, w in self.parts(version).items() if only is None or p in only}
        schema = self._schema().add("part", IntegerType())
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.base}/data/written={w}/part={p}" for p, w in sorted(parts.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/data").parquet(*paths).drop("written")

    def create(self, rows: DataFrame) -> int:
        """Version 0."""
        rows.limit(0).coalesce(1).write.parquet(f"{self.base}/schema")
        name, there = self._write(rows)
        self._list(0, dict.fromkeys(there, name))
        return 0

    def touched(self, keys: DataFrame, key: str, version: int | None = None) -> set[int]:
        """Parts that hold any of the keys.  Keys that come with the part's
        column need no look into the table; else its key column is read."""
        if self.column in keys.columns:
            own = keys.select(self.part.alias("part"))
        else:
            own = self.read(version).select(key, "part").join(keys.select(key).distinct(), key, "left_semi").select("part")
        return {r["part"] for r in own.distinct().collect()}

    def update(self, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], create: bool = False) -> int:
        """A new version with ``change`` applied to the parts that hold any of
        ``keys``, and, where ``create``, to parts that the table has not yet."""
        version = self.version()
        parts = self.parts(version)
        touched = self.touched(keys, key, version)
        touched = touched if create else touched & set(parts)
        if touched:
            name, there = self._write(change(self.read(version, touched).drop("part")))
            if there - touched:
                raise ValueError("a change must leave a row in its part")
            parts = {p: w for p, w in parts.items() if p not in touched} | dict.fromkeys(there, name)
        self._list(version + 1, parts)
        return version + 1

