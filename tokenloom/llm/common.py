"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only: other scripts keep their case, as the contracts ask."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir.

    The setting is read from the session; where it is unset, local mode (as in tests) has a folder below the
    warehouse, and a cluster, whose machines need not share the warehouse's disk, is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's own setting comes back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    What the job shuffled goes when it is written: else shuffle files of all steps pile up until the driver happens to collect its garbage."""
    path = shared_folder(df.sparkSession)
    with _set(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send Python workers so many rows at once.

    A batch is held several times over, by the JVM outside of its heap and by the worker, so rows of long texts are sent in small ones."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def give_back() -> None:
    """At the end of a task: what the worker has freed goes back to the system, as workers live on into other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; others give back by themselves
    if trim:
        trim(0)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that does not clash with the frame's own columns."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
