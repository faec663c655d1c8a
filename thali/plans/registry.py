"""Named queries: each key builds a Spark DataFrame over the driver tables
at ``sf_dir`` and (where SQL can state it) carries an independent DuckDB
statement over the same raw views, used as the correctness oracle.

The DuckDB texts share only the table adapters with the Spark side
(``thali.sources.adapters``); the operator itself is written twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from thali.sources.adapters import duckdb_ctes
from thali.sources.tables import load_tables, orders_between

# The data has no "now"; these are the IST dates used as today.
AS_OF = date(2001, 7, 31)
EVENTS_AS_OF = date(2024, 1, 30)
# Fixed custom range used by the custom-period queries (inside the data).
RANGE_START = date(2001, 5, 1)
RANGE_END = date(2001, 7, 15)


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Callable[[dict[str, DataFrame]], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return money_as_double(fn(_Tables(spark, sf_dir)))
        REGISTRY[key] = Query(build, oracle)
        return fn
    return deco


def money_as_double(df: DataFrame) -> DataFrame:
    """Registered results report money as double, like the reference's JSON.

    Operators keep ``DECIMAL`` (exact sums); only top-level decimal output
    columns are cast, as the last projection.
    """
    dec = {f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)}
    if not dec:
        return df
    return df.select(*[F.col(c).cast("double").alias(c) if c in dec else F.col(c) for c in df.columns])


def dbl(*cols: str) -> str:
    """DuckDB ``* REPLACE`` clause casting the named money columns to double."""
    return "replace (" + ", ".join(f"cast({c} as double) as {c}" for c in cols) + ")"


class _Tables(dict):
    """Lazily loaded business tables; raw driver tables via ``raw(name)``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __missing__(self, name: str) -> DataFrame:
        df = load_tables(self.spark, self.sf_dir, (name,))[name]
        self[name] = df
        return df

    def orders_between(self, start: date, end: date) -> DataFrame:
        """Orders with a coarse bound on the stored date, for the scan to prune by."""
        return orders_between(self.spark, self.sf_dir, start, end)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")


def sql(*tables: str) -> Callable[[str], str]:
    """Prefix an oracle statement with the adapter CTEs it reads."""
    head = duckdb_ctes(*tables) if tables else ""

    def body(text: str) -> str:
        text = text.strip()
        if head and text.lower().startswith("with "):
            return head + ",\n" + text[5:]
        return head + "\n" + text
    return body


def ist_day(col: str) -> str:
    """DuckDB: IST calendar date of a UTC timestamp."""
    return f"cast({col} + interval 330 minute as date)"


def d(x: date) -> str:
    return f"date '{x.isoformat()}'"


def ts(x: date) -> str:
    return f"timestamp '{x.isoformat()} 00:00:00'"
