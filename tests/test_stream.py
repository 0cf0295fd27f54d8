"""The stream's sessions against the batch replay: restarts, a start from a state, idle sessions, the size of the state."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import sessions as Z
from tokenloom.plans.sessions_catalog import PLAN, messages, requests
from tokenloom.streaming.compaction import OUTPUT, compact_stream, session_states

D = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "seq", "history_tokens", "first_seq", "n_messages", "summary", "compactions"]


@pytest.fixture(scope="module")
def told(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield messages(spark, D).withColumn("conv_id", F.col("conv_id").cast("long")).cache()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, told, base, **options):
    """What is written to the source so far goes through the stream, which is started anew; its progress."""
    stream = compact_stream(spark.readStream.schema(told.schema).parquet(f"{base}/in"), PLAN, **options)
    # With timers a query looks for ended sessions for ever, so it gets one batch.
    trigger = {"once": True} if "idle_ms" in options else {"availableNow": True}
    query = stream.writeStream.format("json").option("path", f"{base}/out").trigger(**trigger).option("checkpointLocation", f"{base}/cp").start()
    assert query.awaitTermination(120)
    return query.lastProgress


def results(spark, base):
    return sorted(tuple(r[c] for c in COLUMNS) for r in spark.read.schema(OUTPUT).json(f"{base}/out").where("not late").collect())


def batch(spark):
    asked = requests(spark, D)
    got = Z.compact_sessions(messages(spark, D), asked, PLAN).withColumn("seq", F.col("request_id"))
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def test_restarts_between_batches(spark, told, tmp_path):
    base = str(tmp_path)
    for low, high in ((0, 3), (3, 4), (4, 99)):
        told.where((F.col("turn") >= low) & (F.col("turn") < high)).repartition(1).write.mode("append").parquet(f"{base}/in")
        progress = feed(spark, told, base)
    assert results(spark, base) == batch(spark)
    # A row of counters for each session, and its messages since the last fold only.
    rows, sessions = progress["stateOperators"][0]["numRowsTotal"], told.select("conv_id").distinct().count()
    held = sum(len(json.loads(r["messages"])) for r in session_states(told, PLAN).collect())
    assert sessions < rows <= 3 * sessions + held and held < told.count() and progress["stateOperators"][0]["memoryUsedBytes"] > 0


def test_start_from_a_batch(spark, told, tmp_path):
    base = str(tmp_path)
    told.where("turn >= 4").repartition(1).write.parquet(f"{base}/in")
    feed(spark, told, base, state=session_states(told.where("turn < 4"), PLAN))
    assert results(spark, base) == [r for r in batch(spark) if r[1] >= 4]


def test_idle_sessions_end(spark, told, tmp_path):
    base = str(tmp_path)
    one = told.agg(F.min("conv_id")).first()[0]
    for turns in ("turn < 4", "turn < 0 or conv_id <> {0} and turn = 4", "conv_id = {0} and turn >= 4"):
        told.where(turns.format(one)).repartition(1).write.mode("append").parquet(f"{base}/in")
        feed(spark, told, base, idle_ms=1)
    again = [r for r in results(spark, base) if r[0] == one and r[1] >= 4]
    # The session began anew: its first request of the third run sees nothing of the four turns before.
    assert again and again[0][4] == 0 and again[0][6] == 0
