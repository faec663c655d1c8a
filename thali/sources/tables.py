"""Loading the business tables (S1) and reporting which exist."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.functions.temporal import ntz
from thali.sources.adapters import ADAPTER_INPUTS, render

BUSINESS_TABLES = ("users", "orders", "order_items", "payments", "addresses", "services", "menu")
# Fixed value: the tables the service checks for at start-up.
REQUIRED_TABLES = ("users", "orders", "order_items", "payments", "addresses")
# Raw driver tables each business table is derived from.
RAW_SOURCES = {
    "users": ("customer",),
    "orders": ("orders", "customer"),
    "order_items": ("lineitem", "part"),
    "payments": ("orders", "customer"),
    "addresses": ("customer",),
    "services": ("part",),
    "menu": ("part",),
}


def read_raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One driver table; parquet keeps pushdown and column pruning."""
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def load_table(spark: SparkSession, path: str, name: str,
               _cache: dict[str, DataFrame] | None = None) -> DataFrame:
    """Business table ``name`` as a lazy frame over the driver parquet."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    frames: dict[str, DataFrame] = {}
    for raw in ADAPTER_INPUTS[name]:
        if raw.startswith("f_"):
            frames[raw] = load_table(spark, path, raw[2:], cache)
        else:
            frames[raw] = read_raw(spark, path, raw)
    df = spark.sql(render(name, "spark"), **frames)
    cache[name] = df
    return df


def orders_between(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """Orders whose raw date allows an ``order_date`` in ``[start, end]`` (UTC
    or IST days): a coarse range on the stored column, which reaches the scan.
    Callers still apply their exact predicate."""
    raw = read_raw(spark, path, "orders")
    lo, hi = start - timedelta(days=2), end + timedelta(days=2)
    near = raw.where((F.col("o_orderdate") >= ntz(lo)) & (F.col("o_orderdate") < ntz(hi)))
    return spark.sql(render("orders", "spark"), orders=near, customer=read_raw(spark, path, "customer"))


def load_tables(spark: SparkSession, path: str,
                names: tuple[str, ...] = BUSINESS_TABLES) -> dict[str, DataFrame]:
    """The business tables as lazy frames keyed by name.

    A live PostgreSQL source would swap ``read_raw`` for ``spark.read.jdbc``
    with ``partitionColumn`` / ``numPartitions`` so the read is parallel.
    """
    cache: dict[str, DataFrame] = {}
    return {n: load_table(spark, path, n, cache) for n in names}


def table_report(spark: SparkSession, path: str,
                 names: tuple[str, ...] = REQUIRED_TABLES) -> DataFrame:
    """For each required business table: whether all its sources exist.

    The folder listing is a Spark job (``binaryFile`` with only the path
    column selected, so no file content is read).
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.regexp_extract("path", r"/([^/]+)\.parquet(/|$)", 1).alias("source"))
        .where(F.col("source") != "")
        .distinct()
    )
    wanted = spark.createDataFrame(
        [(t, s) for t in names for s in RAW_SOURCES[t]], "table string, source string")
    return (
        wanted.join(found.withColumn("hit", F.lit(1)), "source", "left")
        .groupBy("table")
        .agg(F.min(F.coalesce("hit", F.lit(0))).cast("boolean").alias("present"))
    )
