"""What steps leave on disk: shuffle files go with the step that made them, elements of one row are not shuffled with their node."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import jaccard_join as J
from tokenloom.llm.common import materialise


def shuffled(spark) -> set[Path]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_materialise_keeps_no_shuffle_files(spark):
    before = shuffled(spark)
    made = materialise(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.max("id").alias("m")))
    assert made.count() == 7_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    late = time.time() + 20
    while (left := {p for p in shuffled(spark) - before if p.stat().st_size > 10_000}) and time.time() < late:
        time.sleep(0.2)
    assert not left


def test_repeated_elements(spark, monkeypatch):
    monkeypatch.setattr(J, "DEALT", 3_000)  # several buckets
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 20_000, dtype=np.int64)
    rows = [elements[i : i + 100].tolist() for i in range(0, 20_000, 100)] + [elements[5:8].tolist(), elements[19_000:19_001].tolist(), []]
    found = J.repeated(spark.createDataFrame([(r,) for r in rows], "prefix array<long>").repartition(5))
    held = found.holds(elements.view(np.uint64))
    assert held[[5, 6, 7, 19_000]].all()
    assert held.sum() < 0.05 * len(elements)
    none = J.repeated(spark.createDataFrame([], "prefix array<long>"))
    assert not none.holds(elements.view(np.uint64)).any()
