"""Helpers shared by the operators: word rules, shared tables, a join that a
hot key cannot skew."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words, as a Java pattern.
GAP = r"[\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z in lower case and nothing else changed."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Words of a non-null text as an array."""
    return F.array_remove(F.split(c, GAP), "")


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A fixed table as a projection of literals."""
    names, types = zip(*[f.strip().split(" ", 1) for f in schema.split(",")])
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, types, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def fenced(c: Column) -> Column:
    """``c`` behind a condition that always holds but that the optimiser
    cannot fold, so a filter on ``c`` is not pushed below its projection.

    Pushed down, each mention of an intermediate array would become the whole
    expression that makes it, evaluated once an element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def nested(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the whole row as ``_row``: whatever names the
    other columns have, they meet none of an operator's own."""
    return rows.select(*[rows[c] for c in columns], F.struct(*[rows[c] for c in rows.columns]).alias("_row"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the checkpoint folder that the
    session's owner has set.  A session of one machine (``local[...]``), whose
    executors are the driver itself, may leave both unset: the folder is then in
    the warehouse."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/thali-checkpoints"
    return base.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts the lineage with files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/thali-llm/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut small, at most ``rows`` rows and, but for a single
    longer row, ``size`` bytes of texts, so a task holds the Python values of a
    few texts at a time."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def lookup(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row a key) on ``key``.

    ``size`` is the column of ``table`` with how many of the ``total`` rows
    hold the key.  Keys with more than ``total / parts`` rows are fewer than
    ``parts`` by counting, so those alone are broadcast; their rows get a
    place by their own hash in the shuffle that joins the others (the same
    place when a lost task runs again).
    """
    values = [c for c in table.columns if c != key]
    hot = table.where(F.col(size) > total / parts).select(key, F.struct(*values).alias("_hot"))
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)))
    rest = table.select(key, F.lit(0).cast("long").alias("_spread"), F.struct(*values).alias("_rest"))
    out = (rows.join(F.broadcast(hot), key, "left").withColumn("_spread", spread.cast("long"))
           .join(rest, [key, "_spread"], "left").withColumn("_value", F.coalesce("_hot", "_rest")))
    return out.select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in values])
