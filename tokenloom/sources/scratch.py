"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists are broadcast only up to so many rows.
BROADCAST_ROWS = 300_000


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode without that setting, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Written and read back: computed once, also where it is read several times, and safe from lost executors.

    What the job shuffled goes when it is written, as shuffle files would else pile up until the driver happens to collect its garbage."""
    path, conf, name = scratch_folder(df.sparkSession), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, made: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """What was ``made`` of a written frame, marked for a broadcast if the frame has few enough rows."""
    return F.broadcast(made) if df.limit(rows + 1).count() <= rows else made


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame, marked for a broadcast if it has few enough rows."""
    return beside(df, df, rows)
