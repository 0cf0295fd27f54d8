"""Contexts are judged by their text in their row; what is kept of them has no text."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tokenloom.operators import scoring as G
from tokenloom.operators import sessions as Z
from tokenloom.plans import scoring_catalog as S

SF = "/root/testdata/sf0.001"


def test_judged_contexts_keep_no_text(spark):
    kept = S._checked(spark, SF)
    assert not {"text", "documents", "memory", "summary", "must_contain"} & set(kept.columns)
    texts = S._contexts(spark, SF).withColumn("within", F.col("tokens") <= S.PLAN.budget)
    want = G.fact_checks(texts.select("conv_id", "request_id", "strategy", "text", "within"), S._facts(spark, SF), ("conv_id",))
    at = ["conv_id", "request_id", "strategy", "within", "found", "needed", "answerable"]
    assert sorted(map(str, kept.where("asked").select(*at).collect())) == sorted(map(str, want.select(*at).collect()))
    assert kept.count() == texts.count()


def test_matrix_is_made_of_judged_contexts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "written", lambda df: seen.append(df.columns) or df)
    matrix = entry.queries()["question_matrix"](spark, SF)
    assert seen and not any("text" in columns for columns in seen)
    assert set(Z.STRATEGIES) < set(matrix.columns)


def test_shown_messages_are_gathered_once(spark):
    """A request's strategies show runs of the same messages; an old result is a stub in some and its text in others."""
    plan = Z.Plan(window=400, reserve=0, margin=0, keep_tools=1)
    said = [(1, i, i, "tool" if i % 2 else "user", f"word{i} " * 5, "call" if i % 2 else None) for i in range(6)]
    messages = spark.createDataFrame(said, "conv_id long, seq long, turn long, role string, content string, tool_call string")
    requests = spark.createDataFrame([(1, 9, "ask?", [7])], "conv_id long, request_id long, query string, extra array<int>")
    rows = [(1, 9, k, first, n, tokens, "", "", "") for k, first, n, tokens in [("cleared", 0, 6, 100), ("whole", 2, 4, 100), ("none", 6, 0, 100), ("over", 0, 6, 401)]]
    contexts = spark.createDataFrame(rows, "conv_id long, request_id long, strategy string, first_seq long, n_messages long, tokens long, summary string, memory string, documents string")
    got = {r["strategy"]: r for r in Z.context_texts(contexts, messages, requests, "sys", plan, ("cleared",), ("extra",)).collect()}
    text = {k: r["text"] for k, r in got.items()}
    assert text["over"] is None and "word" not in text["none"] and got["none"]["extra"] == [7]
    # Only the last result stands as it is where results are cleared.
    assert [f"word{i} word" in text["cleared"] for i in range(6)] == [True, False, True, False, True, True] and text["cleared"].count("[cleared") == 2
    assert [f"word{i} word" in text["whole"] for i in range(6)] == [False, False, True, True, True, True] and "[cleared" not in text["whole"]
