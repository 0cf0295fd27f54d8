"""What a search for packing keeps: the same picks from few rows, and no shuffle files."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import retrieval as R
from tokenloom.sources.scratch import written


@pytest.mark.parametrize("most, places", [(30, 1_000_000), (30, 700), (8, 100), (200, 700)])
def test_packs_are_those_of_the_full_search(spark, monkeypatch, most, places):
    rng = random.Random(most)
    vocabulary = [f"t{i}" for i in range(60)]
    # Many equal chunks, so scores tie.
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 45))) for _ in range(250)]
    docs = [(i, 0, "c", (t := rng.choice(texts)), len(t.split())) for i in range(900)]
    chunks = spark.createDataFrame(docs, "doc_id long, chunk_no int, title string, text string, tokens long").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 8)))) for q in range(50)] + [(90, "nothing"), (91, ""), (92, None)], "query_id long, text string")
    allowed = queries.select("query_id", F.explode(F.array(F.lit(0), F.lit(most // 2 + R.WRAPPER), F.lit(most + R.WRAPPER))).alias("allowed")).withColumn("kind", F.col("allowed"))
    full = R.bm25_near(queries, chunks)
    want = sorted(map(tuple, R.pack_chunks(full, chunks, allowed).collect()))
    monkeypatch.setattr(R, "PLACES", places)
    kept = R.bm25_near(queries, chunks, most=most)
    got = sorted(map(tuple, R.pack_chunks(kept, chunks, allowed).collect()))
    assert got == want and want
    assert kept.count() < 0.6 * full.count()


def test_written_keeps_no_shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}
    before = files()
    assert written(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.max("id").alias("m"))).count() == 7_000
    late = time.time() + 20
    while (left := {p for p in files() - before if p.exists() and p.stat().st_size > 10_000}) and time.time() < late:
        time.sleep(0.2)
    assert not left
