"""Searches by trigram postings (F1-F3 on tables that are searched often).

A contains-search without an index reads every text.  Here each row's texts are
cut once in their distinct trigrams (of the lower-cased text), stored as rows
(gram, key) sorted by gram, so a search reads the postings of its own grams
alone: a row that contains the text has all of them.  The rows so found are
read by their keys and verified with the very predicate of the plain search.

The search text's ``%`` and ``_`` are wildcards, as in the plain search, and part
it; a text without three plain characters in a row, or with a backslash, has no
grams to ask for and falls back to the plain search.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Found rows up to this many are read by a list of keys that reaches the scan,
#: more by a join.
KEYS_LISTED = 1000


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))


def grams_of(spark: SparkSession, text: str) -> list[str]:
    """The trigrams that any match of a search text contains."""
    if "\\" in text:
        return []
    low = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    parts = re.split("[%_]", low)
    return sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})


class TextIndex:
    """Postings of the texts of a table in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def build(self, rows: DataFrame, texts: list[Column]) -> TextIndex:
        """Write the postings of ``rows`` (unique ``key``).  They are sorted in
        ranges by (gram, key), so a gram that a third of the rows have spreads."""
        own = F.array_distinct(F.flatten(F.filter(F.array(*[_grams(t) for t in texts]), lambda g: g.isNotNull())))
        postings = rows.select(F.explode(own).alias("gram"), self.key)
        postings.repartitionByRange("gram", self.key).sortWithinPartitions("gram", self.key).write.mode("overwrite").parquet(self.path)
        return self

    def candidates(self, text: str) -> DataFrame | None:
        """Keys of the rows that have all grams of ``text``; None without any."""
        grams = grams_of(self.spark, text)
        if not grams:
            return None
        found = self.spark.read.parquet(self.path).where(F.col("gram").isin(grams))
        return found.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).select(self.key)

    def search(self, rows: DataFrame, text: str | None, plain: Callable[[DataFrame, str | None], DataFrame]) -> DataFrame:
        """What ``plain(rows, text)`` gives, reading only rows that may match."""
        keys = self.candidates(text) if text else None
        if keys is None:
            return plain(rows, text)
        first = [r[0] for r in keys.limit(KEYS_LISTED + 1).collect()]
        some = rows.where(F.col(self.key).isin(first)) if len(first) <= KEYS_LISTED else rows.join(keys, self.key, "left_semi")
        return plain(some, text)


def order_texts() -> list[Column]:
    """What F1 searches of an order."""
    return [F.col("user_name"), F.col("user_phone"), F.col("user_email"), F.col("order_id").cast("string")]


def customer_texts() -> list[Column]:
    """What F2 searches of a customer."""
    return [F.col("full_name"), F.col("phone"), F.col("email")]
