"""Session defaults for local runs and a reader for the shared checkpoint folder.

On a cluster the session comes from the platform; operators never rely on
anything set here except what they read back from ``spark.conf``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "thali", driver_memory: str | None = None) -> SparkSession:
    """A local session with the settings the operators assume.

    * UTC session zone, so the few places that need ``TIMESTAMP`` (streaming
      watermarks) mean UTC like the stored ``TIMESTAMP_NTZ`` values.
    * AQE on, with partition coalescing and skew-join splitting.
    * No web UI.
    * The heap is the caller's choice (``driver_memory``), else Spark's default.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster sets it to a filesystem that all executors and the next driver
    see; without it stream offsets and state would be lost with this machine,
    so a session that names none is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return named


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for tables that a job writes on its way.

    As ``checkpoint_dir``; a session of one machine (``local[...]``), whose
    executors are the driver itself, may name none and then uses a folder in
    its warehouse.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and (sc.master or "").startswith("local["):
        named = spark.conf.get("spark.sql.warehouse.dir") + "/thali-checkpoints"
    return (named or checkpoint_dir(spark)).rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts
    the lineage with files that outlive any executor."""
    path = f"{shared_folder(df.sparkSession)}/thali/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
