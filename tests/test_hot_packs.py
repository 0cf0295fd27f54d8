"""Packs that hold most of the table: their pages stay where they are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import calls as C
from tokenloom.operators import pages as P


@pytest.fixture
def no_luck(spark):
    """Tables are broadcast only where the code asks for it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def test_pages_of_a_hot_pack_are_not_dealt_by_pack(no_luck):
    """A pack's repeated lines and first pages used to be joined by a shuffle of all texts by pack."""
    rows = [("p", i, f"HEAD {i}\n > quoted\nPage # of 3\npage 2 of 3 \n\x1c\n> \nbody {'abc'[i % 3]}    x") for i in range(6)] + [("q", 7, "alone"), (None, 8, "HEAD 1\nbody")]
    pages = no_luck.createDataFrame(rows, "pack_id string, page_no long, text string")
    cleaned = P.clean_pages(pages, 0.9)
    dropped = P.drop_duplicate_pages(cleaned)
    for df in (cleaned, dropped):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r.pack_id, r.page_no): (r.text, r.dropped_reason) for r in dropped.collect()}
    assert got == {
        **{("p", i): (f"body {'abc'[i % 3]}  x", None if i < 3 else f"duplicate of page {i % 3}") for i in range(6)}, ("q", 7): ("", None), (None, 8): ("HEAD 1\nbody", None),
    }


def test_evidence_of_all_packs_is_not_repeated_for_each(spark):
    """Passages that every pack looks for used to come once for each pack, and so to every shuffle."""
    texts = [("p", 1, "a fact stands"), ("p", 2, "here and\nthere"), ("q", 3, "fact here and there"), ("q", 4, None), (None, 5, "a fact")]
    calls = spark.createDataFrame(texts, "pack_id string, call_id long, text string")
    shared = spark.createDataFrame([("f", "a fact"), ("g", "here and there"), ("g", "fact"), ("h", "here  and there"), ("i", "")], "field_key string, phrase string")
    each = calls.select("pack_id").distinct().crossJoin(shared)
    rows = lambda df: sorted(map(tuple, df.select("pack_id", "call_id", "field_key").collect()))
    assert rows(C.covered_fields(calls, shared)) == rows(C.covered_fields(calls, each)) == [("p", 1, "f"), ("p", 1, "i"), ("p", 2, "h"), ("p", 2, "i"), ("q", 3, "g"), ("q", 3, "h"), ("q", 3, "i")]
    models = spark.createDataFrame([("big", 100_000, 100), ("small", 520, 100), ("tiny", 150, 100)], "model_key string, context_window long, max_out long")
    pages = calls.where("text is not null").withColumn("text", F.concat("text", F.repeat(F.lit(" filler words here"), 40))).withColumnRenamed("call_id", "page_no").where("pack_id is not null")
    whole = lambda df: sorted(map(str, df.select(*C.CALL).collect()))
    assert whole(C.full_calls(pages, models, shared, 50)) == whole(C.full_calls(pages, models, each, 50))
    routed, groups = pages.withColumn("kind", F.lit("k")).withColumn("task", F.lit("x")), {"x": {"f": None, "g": None}, "y": {"h": None}}
    assert whole(C.routed_calls(routed, pages, shared, groups, models, 50)) == whole(C.routed_calls(routed, pages, each, groups, models, 50))
