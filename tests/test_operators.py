from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tokenloom.functions import text as T
from tokenloom.operators import calls as C
from tokenloom.operators import history as H
from tokenloom.operators import pages as P
from tokenloom.operators import retrieval as R
from tokenloom.operators import scoring as G
from tokenloom.operators import sessions as Z
from tokenloom.sources import io
from tokenloom.streaming.compaction import compact_stream

PACK = [
    (1, "ACME HEALTH  ref 11\nFAX TRANSMISSION\nto us\nPage 1 of 6"),
    (2, "ACME HEALTH  ref 12\nCLAIM FORM\nMember: Chan\nAll information given here is true to the best of my knowledge.\nPage 2 of 6"),
    (3, "ACME HEALTH  ref 13\nInvoice SF-2291 replaces SF-2290.\nTotal    1,200.00\n> old mail\nPage 3 of 6"),
    (4, "ACME HEALTH  ref 14\nInvoice SF-2291 replaces SF-2290.\nTotal    1,200.00\nDUPLICATE COPY\nPage 4 of 6"),
    (5, "ACME HEALTH  ref 15\nTerms and conditions apply.\n1. All information given here is true to the\nbest of my knowledge. Short one.\nPage 5 of 6"),
    (6, None),
]


@pytest.fixture(scope="module")
def pack(spark):
    return P.load_pages(spark.createDataFrame([("p", n, t) for n, t in PACK], "pack string, n int, t string"), "pack", "n", "t")


def one(df, **at):
    for k, v in at.items():
        df = df.where(F.col(k) == v)
    return df.first()


def test_token_count(spark):
    texts = ["", "one three", "naïve café 12,345.67!", "E-4471 \x1c x", "longer_words here"]
    python = [sum(max(1, math.ceil(len(p) / 4)) if p[0].isalnum() or p[0] == "_" else 1 for p in re.findall(r"\w+|[^\w\s]", t)) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.token_count(F.col("t"))).collect()] == [*python, 0]


def test_prepare(pack):
    ready = P.prepare(pack, 0.5).cache()
    kinds = {r["page_no"]: r["kind"] for r in ready.collect()}
    assert kinds == {1: "fax_cover", 2: "claim_form", 3: "invoice", 4: "invoice", 5: "terms", 6: "unknown"}
    assert one(ready, page_no=4)["dropped_reason"] == "duplicate of page 3"
    assert one(ready, page_no=3)["text"] == "Invoice SF-2291 replaces SF-2290.\nTotal  1,200.00"
    two = one(ready, page_no=2)
    assert two["text"] == "CLAIM FORM\nMember: Chan" and two["notes"] == ["shared boilerplate removed"]
    assert {(r["task"], r["page_no"]) for r in P.route_pages(ready).collect()} == {("member", 2), ("financial", 3)}


def test_boilerplate_against_brute_force(spark):
    rows = [("a", i, kind, t) for i, (kind, t) in enumerate([
        ("terms", "First sentence that is long enough to count as one"), ("terms", "goes over the page end. Then the second sentence here is long enough too."),
        ("other", "x First sentence that is\nlong enough to count as one goes  over the page end. y"), ("other", "Then the second sentence here is long enough too."), ("other", ""),
    ])]
    df = spark.createDataFrame(rows, "pack_id string, page_no int, kind string, text string").withColumn("dropped_reason", F.lit(None).cast("string"))
    got = {r["page_no"]: (r["text"], list(r["notes"])) for r in P.strip_boilerplate(df, ("terms",)).collect()}
    assert got[2] == ("x  y", ["shared boilerplate removed"]) and got[3] == ("", ["shared boilerplate removed"]) and got[4] == ("", [])


def test_retrieval_rules(spark):
    docs = spark.createDataFrame([("d1", "t", "apple banana\n\npear plum\n\nfig"), ("d2", "t", "apple apple apple"), ("d3", "t", None)], "doc_id string, title string, text string")
    chunks = R.chunk_documents(docs, max_tokens=4).cache()
    assert {(r["chunk_id"], r["text"], r["tokens"]) for r in chunks.collect()} == {("d1#0", "apple banana", 4), ("d1#1", "pear plum\n\nfig", 3), ("d2#0", "apple apple apple", 6)}
    ask = spark.createDataFrame([("q", "apple"), ("none", "zebra")], "query_id string, text string")
    ranked = R.bm25_search(ask, chunks)
    assert [r["doc_id"] for r in ranked.orderBy("rank").collect()] == ["d2", "d1"]
    assert R.pack_chunks(ranked, chunks, 100, min_score=99).count() == 0
    # The first does not fit and is skipped, the second is taken.
    assert [r["doc_id"] for r in R.pack_chunks(ranked, chunks, 16, min_relative=0, min_score=0).collect()] == ["d1"]
    assert R.prefill_documents(chunks, 32).count() == 2


def test_tool_clearing(spark):
    rows = [("c", i, i, "tool", "x" * 500, f"read({i})") for i in range(5)]
    got = H.clear_tool_results(spark.createDataFrame(rows, "conv_id string, seq int, turn int, role string, content string, tool_call string"), 2).orderBy("seq").collect()
    assert [r["cleared"] for r in got] == [True] * 3 + [False] * 2 and got[0]["content"].startswith("[cleared 125-token result of read(0);")


def test_compaction_batch_equals_stream(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    from tokenloom.plans.sessions_catalog import PLAN, messages, requests

    batch = Z.compact_sessions(messages(spark, d), requests(spark, d), PLAN).drop("conv_id")
    source = str(tmp_path / "in")
    messages(spark, d).repartition(1).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = compact_stream(spark.readStream.schema(messages(spark, d).schema).parquet(source), PLAN)
    query = stream.writeStream.format("memory").queryName("compacted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    cols = ["history_tokens", "first_seq", "n_messages", "summary", "compactions"]
    got = sorted(map(tuple, spark.table("compacted").where("not late").select(*cols).collect()))
    assert got == sorted(map(tuple, batch.select(*cols).collect())) and max(r[4] for r in got) > 0


@pytest.mark.parametrize("window", [1200, 2400, 4800])
def test_never_over_budget(spark, window):
    d = "/root/testdata/sf0.001"
    from dataclasses import replace

    from tokenloom.plans import sessions_catalog as K

    scale = window / K.PLAN.window
    plan = replace(K.PLAN, window=window, reserve=int(200 * scale), memory=int(100 * scale), documents=int(200 * scale), summary=int(120 * scale))
    got = Z.assemble_engineered(K.messages(spark, d), K.requests(spark, d), K.notes(spark, d), K.chunks(spark, d), plan, K.SYSTEM_TOKENS)
    cut = Z.assemble_truncated(K.messages(spark, d), K.requests(spark, d), K.chunks(spark, d), plan, K.SYSTEM_TOKENS)
    assert got.where(F.col("tokens") > plan.budget).count() == cut.where(F.col("tokens") > plan.budget).count() == 0 and got.count() == 5 * cut.count() > 0
    assert got.where("overflow").count() == 0


def test_small_budget_grants(spark):
    """Notes and documents get what system and query leave, if that is less than their ceilings."""
    d = "/root/testdata/sf0.001"
    from tokenloom.plans import sessions_catalog as K

    plan = Z.Plan(window=500, reserve=0, margin=0.0, memory=400, documents=400, keep_messages=1, keep_tools=1, summary=50)
    got = Z.assemble_engineered(K.messages(spark, d), K.requests(spark, d), K.notes(spark, d), K.chunks(spark, d), plan, 60).collect()
    assert any(r["slot_memory"] for r in got) and any(r["slot_documents"] for r in got)
    for r in got:
        left = max(0, plan.budget - 60 - r["slot_query"])
        assert r["slot_memory"] <= min(400, left) and (r["slot_system"] + r["slot_query"] <= plan.budget or r["overflow"])
        assert (r["strategy"] == "no_memory") <= (r["slot_memory"] == 0) and r["tokens"] == sum(r[f"slot_{k}"] for k in ("system", "memory", "documents", "history", "query"))


def plain_replay(held, upto, remaining, plan, state, clearing, compaction):
    """One request's history by plain lists: clear, compact, drop the oldest, trim the summary."""
    seen = held[:upto]
    tools = [i for i, m in enumerate(seen) if m["role"] == "tool"]
    cost = [m["stub_tokens"] if clearing and m["role"] == "tool" and i in tools[: len(tools) - plan.keep_tools] else m["tokens"] for i, m in enumerate(seen)]
    told = lambda lines: sum(x["cost"] - 1 for x in lines)
    if compaction and sum(cost[state["upto"] :]) + told(state["summary"]) > (remaining - 40) * plan.trigger and upto - state["upto"] > plan.keep_messages:
        end = upto - plan.keep_messages
        pool = [dict(x, score=x["summary_score"]) for x in state["summary"]]
        for m in seen[state["upto"] : end]:
            pool += [] if m["cleared"] else [x.asDict() for x in m["sentences"]]
        kept, used, known = [], 0, set()
        for i in sorted(range(len(pool)), key=lambda i: (-pool[i]["score"], i)):
            if pool[i]["text"].lower() not in known and used + pool[i]["cost"] <= plan.summary:
                known.add(pool[i]["text"].lower())
                kept.append(i)
                used += pool[i]["cost"]
        state.update(summary=[pool[i] for i in sorted(kept)], upto=end, compactions=state["compactions"] + 1)
    summary, first = (list(state["summary"]), state["upto"]) if compaction else ([], 0)
    room = remaining - 40 - told(summary) - (10 if summary else 0)
    while first < upto and sum(cost[first:]) > room:
        first += 1
    size = lambda: (told(summary) + Z.TAG_TOKENS["summary"] if summary else 0) + (sum(cost[first:]) + Z.TAG_TOKENS["conversation"] if first < upto else 0)
    while size() > remaining and summary:
        summary.pop(0)
    return size(), first, upto - first, "\n".join("- " + x["text"] for x in summary), state["compactions"]


def test_engineered_history_by_plain_lists(spark):
    d = "/root/testdata/sf0.001"
    from tokenloom.plans import sessions_catalog as K

    built = Z.assemble_engineered(K.messages(spark, d), K.requests(spark, d), K.notes(spark, d), K.chunks(spark, d), K.PLAN, K.SYSTEM_TOKENS).collect()
    sessions = {}
    for m in Z.counted_messages(K.messages(spark, d)).orderBy("conv_id", "seq").collect():
        sessions.setdefault(m["conv_id"], []).append(m)
    states, dropped = {}, 0
    for r in sorted(built, key=lambda r: (r["conv_id"], r["strategy"], r["request_id"])):
        held = sessions[r["conv_id"]]
        state = states.setdefault((r["conv_id"], r["strategy"]), {"summary": [], "upto": 0, "compactions": 0})
        upto = sum(m["turn"] < r["request_id"] for m in held)
        remaining = K.PLAN.budget - r["slot_system"] - r["slot_query"] - r["slot_memory"] - r["slot_documents"]
        want = plain_replay(held, upto, remaining, K.PLAN, state, r["strategy"] != "no_clearing", r["strategy"] != "no_compaction")
        assert (r["slot_history"], r["first_seq"], r["n_messages"], r["summary"], r["compactions"]) == want, r
        dropped += r["first_seq"] > 0
    assert dropped and any(r["compactions"] for r in built)


def test_context_texts_hold_what_is_counted(spark):
    """A context's text has the tokens that its slots say, in every strategy, and none if it is over the budget."""
    d = "/root/testdata/sf0.001"
    from tokenloom.plans import scoring_catalog as S
    from tokenloom.plans import sessions_catalog as K

    got = S._contexts(spark, d).withColumn("n", T.token_count(F.col("text"))).collect()
    assert {r["strategy"] for r in got} == set(Z.STRATEGIES)
    for r in got:
        assert (r["text"] is None) == (r["tokens"] > K.PLAN.budget)
        assert r["text"] is None or r["n"] == r["tokens"], (r["strategy"], r["n"], r["tokens"], r["text"])
    fresh = [r for r in got if r["request_id"] == S.NEW_SESSION]
    assert fresh and all(r["n_messages"] == 0 and not r["summary"] for r in fresh) and any(r["memory"] for r in fresh)
    # Engineered contexts cost less than truncated ones and answer more of the questions; nothing can be sent where all is.
    rows = {r["strategy"]: r for r in entry.queries()["strategy_summary"](spark, d).collect()}
    engineered, truncated = rows["engineered"], rows["truncated"]
    assert engineered["total"] < truncated["total"] and engineered["answerable"] > truncated["answerable"] and engineered["over"] == truncated["over"] == 0
    assert rows["unbounded"]["answerable"] == 0 and rows["unbounded"]["over"] > 0 and truncated["questions"] > 0
    # Only notes outlive a session.
    assert int(engineered["new_session"].split("/")[0]) > 0
    assert rows["no_memory"]["new_session"].startswith("0/") and {r["new_session"].split("/")[1] for r in rows.values()} == {str(len({r["conv_id"] for r in fresh}))}


def test_scoring(spark):
    truth = spark.createDataFrame([("p", "2026-08-13", 120000.0, True, "Dr. K. Wong")], "pack_id string, admitted string, amount double, over boolean, doctor string")
    kinds = {"admitted": "date", "amount": "number", "over": "bool", "doctor": "text"}
    right = spark.createDataFrame([("p", "13 August 2026", "HKD 120,000.00", "TRUE", "Dr K Wong")], "pack_id string, admitted string, amount string, over string, doctor string")
    wrong = spark.createDataFrame([("p", "14/08/2026", "12000", "false", "")], right.schema)
    assert all(r["correct"] for r in G.score_scalars(truth, right, ["pack_id"], kinds).collect())
    assert not any(r["correct"] for r in G.score_scalars(truth, wrong, ["pack_id"], kinds).collect())
    items = "pack_id string, diagnoses array<struct<icd10:string,primary:boolean>>"
    expected = spark.createDataFrame([("p", [("K35.80", True), ("I10", False)])], items)
    got = spark.createDataFrame([("p", [("k3580", False), ("I10", None)])], items)
    assert {r["field_key"]: r["correct"] for r in G.score_codes(expected, got, "pack_id", "diagnoses", "icd10", "primary").collect()} == {"K35.80": False, "I10": True}


def test_superseded(pack):
    assert [tuple(r) for r in G.supersessions(pack).collect()] == [("p", "SF-2290", "SF-2291")]


def test_windows(spark, pack):
    fits = {r["model_key"]: r["fits"] for r in C.plan_full(pack, C.profiles(spark), 5000).collect()}
    assert fits == {"estimate": True, "small": True, "long": True, "local": True}
    status = {r["model_key"]: r["status"] for r in C.chunk_packs(pack, C.profiles(spark), 6000).collect()}
    assert status["local"] == "no_room" and status["long"] == "one_call"


def test_terms(spark):
    texts = ["", "...", "The API-v2 of Café", "a", "x9  x9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.terms(F.col("t"))).collect()] == [[], [], ["api", "v2", "caf"], [], ["x9", "x9"], []]


def test_routed_tokens_without_joined_text(spark, pack):
    """The sum over pages is the count of the rendered text, which is never made."""
    routed = P.classify_pages(pack).withColumn("task", F.lit("t"))
    planned = C.plan_routed(routed, pack, ["none", "t"], C.profiles(spark), 100)
    rendered = P.render_pages(routed, ("pack_id", "task")).select(T.token_count(F.col("rendered"))).first()[0]
    assert {(r["task"], r["tokens_in"]) for r in planned.collect()} == {("none", 100 + C.FRAME), ("t", rendered + 100 + C.FRAME)}
    assert "collect_list" not in planned._jdf.queryExecution().optimizedPlan().toString()


def test_calls_split_evidence(spark):
    """A window too small for the pack cuts it into chunks; a field whose phrases stand in different chunks is lost, even after merging."""
    pages = spark.createDataFrame([("p", i, f"page {i} " + "filler words here " * 30 + ("the first fact stands" if i == 0 else "the second fact stands" if i == 5 else "")) for i in range(6)], "pack_id string, page_no int, text string")
    evidence = spark.createDataFrame([("p", "a.one", "the first fact stands"), ("p", "b.two", "the second  fact stands"), ("p", "b.both", "the first fact stands"), ("p", "b.both", "the second fact stands"), ("p", "c.short", "facts"), ("p", "c.no", "not there at all")], "pack_id string, field_key string, phrase string")
    models = spark.createDataFrame([("big", 100_000, 100), ("small", 700, 100), ("tiny", 150, 100)], "model_key string, context_window long, max_out long")
    full = C.full_calls(pages, models, evidence, 50).orderBy("call_no").collect()
    tasks = {m: [r["task"] for r in full if r["model_key"] == m] for m in ("big", "small", "tiny")}
    assert tasks["big"] == ["all"] and tasks["small"][-1] == "merge" and len(tasks["small"]) >= 3 and tasks["tiny"] == ["no_room"]
    by = {(r["model_key"], r["task"]): r for r in full}
    assert by["big", "all"]["covers"] == ["a.one", "b.both", "b.two"] and by["small", "merge"]["covers"] == ["a.one", "b.two"] and by["tiny", "no_room"]["covers"] == []
    assert all(r["tokens_in"] + r["max_out"] <= 700 for r in full if r["model_key"] == "small") and not by["tiny", "no_room"]["fits"]
    assert by["small", "merge"]["tokens_in"] == sum(r["tokens_out"] for r in full if r["model_key"] == "small" and r["task"] != "merge") + 50 + C.FRAME
    answer = '{"a.one":{"value":"the first fact stands","source_quote":"the first fact stands","confidence":0.95},"b.two":{"value":"the second  fact stands","source_quote":"the second  fact stands","confidence":0.95}}'
    assert by["small", "merge"]["tokens_out"] == spark.range(1).select(T.token_count(F.lit(answer))).first()[0]
    for r in full:
        if r["text"]:
            assert r["tokens_in"] == spark.range(1).select(T.token_count(F.lit(r["text"]))).first()[0] + 50 + C.FRAME
    routed = pages.withColumn("kind", F.lit("k")).withColumn("task", F.when(F.col("page_no") == 0, "x").otherwise("y"))
    calls = {(r["model_key"], r["task"]): r for r in C.routed_calls(routed, pages, evidence, {"x": {"a": None}, "y": {"b[]": ["two"]}}, models, 50).collect()}
    assert calls["big", "x"]["covers"] == ["a.one"] and calls["big", "y"]["covers"] == ["b.two"] and not calls["tiny", "y"]["fits"]
    owned = C.field_task(evidence, {"x": {"a": None}, "y": {"b[]": ["two"]}}).select("field_key", "task").distinct().collect()
    assert {r[0]: r[1] for r in owned} == {"a.one": "x", "b.two": "y", "b.both": "?", "c.short": "?", "c.no": "?"}


def test_covered_fields_brute_force(spark):
    texts = {"1": "a  fact\nof three", "2": "xa fact of threey", "3": "fact", "4": "two words", "5": "", "6": "a fact of\tthree and two words"}
    phrases = {"f": ["a fact of three"], "g": ["a fact of  three", "two words"], "h": ["fact"], "i": [" of "], "j": ["missing words here"]}
    calls = spark.createDataFrame([("p", k, t) for k, t in texts.items()] + [("other", "9", texts["1"])], "pack_id string, call_id string, text string")
    evidence = spark.createDataFrame([("p", k, x) for k, xs in phrases.items() for x in xs], "pack_id string, field_key string, phrase string")
    flat = lambda x: " ".join(x.split()) if x.strip() == x else " " + " ".join(x.split()) + " "
    want = {("p", c, f) for c, t in texts.items() for f, xs in phrases.items() if all(flat(x) in flat(t) for x in xs)}
    assert {tuple(r) for r in C.covered_fields(calls, evidence).select("pack_id", "call_id", "field_key").collect()} == want and len(want) > 5


def test_pipeline_report(spark):
    models = spark.createDataFrame([("m", 1.0, 2.0), ("free", None, None)], "model_key string, price_in double, price_out double")
    rows = [("p", m, p, i, o, True) for m in ("m", "free") for p, i, o in (("full", 1500, 500), ("routed", 300, 100), ("routed", 100, 0))] + [("q", "m", "full", 9000, 9, False), ("q", "m", "routed", 40, 10, True)]
    calls = spark.createDataFrame(rows, "pack_id string, model_key string, pipeline string, tokens_in long, tokens_out long, fits boolean")
    fields = spark.createDataFrame([("p", "m", "full", f"k{i}") for i in range(4)] + [("p", "m", "routed", f"k{i}") for i in range(3)] + [("q", "m", "full", "k")], "pack_id string, model_key string, pipeline string, field_key string")
    got = {(r["model_key"], r["pipeline"]): r for r in C.pipeline_report(calls, fields, models).collect()}
    full, routed = got["m", "full"], got["m", "routed"]
    assert (full["packs"], full["failed"], full["calls"], full["tokens"], full["fields"], full["saving"]) == (2, 1, 1, 2000, 4, 0)
    assert (routed["packs"], routed["failed"], routed["calls"], routed["tokens_in"], routed["tokens_out"], routed["fields"], routed["saving"]) == (2, 0, 3, 440, 110, 3, 0.75)
    assert got["free", "full"]["cost"] is None and got["free", "full"]["fields"] == 0


def test_nested_answers_and_replies(spark):
    import json

    kind = "id int, member struct<name:string,sums:array<struct<n:double,tags:array<string>>>>, note string"
    rows = spark.createDataFrame([(1, ("A", [(1.5, ["x", "y"]), (None, None)]), None)], kind)
    plain = json.loads(G.reference_answers(rows, ["id"], ["member", "note"]).first()["answer"])
    assert plain == {"member": {"name": "A", "sums": [{"n": 1.5, "tags": ["x", "y"]}, {}]}}
    text = G.reference_answers(rows, ["id"], ["member"], wrapped=True).first()["answer"]
    leaf = lambda v, q: {"value": v, "source_quote": q, "confidence": 0.95}
    assert json.loads(text)["member"]["sums"][0] == {"n": leaf(1.5, "1.5"), "tags": [leaf("x", "x"), leaf("y", "y")]}
    told = "struct<value:{},source_quote:string,confidence:double>"
    schema = f"struct<member:struct<name:{told.format('string')},sums:array<struct<n:{told.format('double')},tags:array<{told.format('string')}>>>>>"
    reply = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema).alias("r"))
    got = reply.select(G.unwrap(F.col("r"), reply.schema["r"].dataType).alias("u")).first()["u"].asDict(True)
    assert got["member"]["name"] == "A" and got["member"]["sums"][0] == {"n": 1.5, "tags": ["x", "y"]}


def test_score_fields_over_all_groups(spark):
    kind = "pack_id string, admitted string, diagnoses array<struct<icd10:string,primary:boolean>>, procedures array<struct<code:string>>, invoices array<struct<invoice_number:string,amount:double>>"
    truth = spark.createDataFrame([("p", "2026-08-13", [("K35.80", True)], [("01480",)], [("SF-1", 10.0)])], kind)
    old = spark.createDataFrame([("p", "SF-2290")], "pack_id string, invoice_number string")
    score = lambda got: {r["field_key"]: r["correct"] for r in G.score_fields(truth, got, old, {"admitted": "date"}, {"diagnoses": ("icd10", "primary", None), "procedures": ("code", None, {"01480": ["44970"]})}).collect()}
    good = spark.createDataFrame([("p", "13 August 2026", [("k3580", True)], [("44970",)], [("sf 1", 10.0)])], kind)
    bad = spark.createDataFrame([("p", "13/08/2025", [("K35.80", False)], [("x",)], [("SF-1", 10.0), ("SF-2290", 42000.0)])], kind)
    assert score(good) == {"admitted": True, "diagnoses.K35.80": True, "procedures.01480": True, "invoices.SF-1": True, "invoices.no_superseded": True}
    assert score(bad) == {"admitted": False, "diagnoses.K35.80": False, "procedures.01480": False, "invoices.SF-1": True, "invoices.no_superseded": False}


def test_strategy_summary_and_matrix(spark):
    contexts = spark.createDataFrame(
        [("c", "x", 10, 1), ("c", "x", 30, 2), ("d", "x", 20, 3), ("c", "y", 5, 0)], "conv_id string, strategy string, tokens long, compactions long"
    )
    checks = spark.createDataFrame(
        [("q1", "x", True, True), ("q2", "x", True, False), ("q3", "x", False, False)], "qid string, strategy string, within boolean, answerable boolean"
    )
    got = {r["strategy"]: r for r in G.strategy_summary(contexts, checks, 25).collect()}
    x, y = got["x"], got["y"]
    assert (x["requests"], x["total"], x["mean"], x["peak"], x["over"], x["compactions"], x["questions"], x["answerable"], x["answerable_pct"]) == (3, 60, 20, 30, 1, 5, 3, 1, 33.3)
    assert (y["questions"], y["answerable_pct"]) == (0, 0.0)
    matrix = {r["qid"]: (r["x"], r["y"]) for r in G.question_matrix(checks, ["x", "y"]).collect()}
    assert matrix == {"q1": ("yes", None), "q2": ("-", None), "q3": ("over", None)}


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "notes")
    io.append_notes(spark.createDataFrame([(3, "Rollback target is v3.8.2")], io.NOTES), path)
    io.append_notes(spark.createDataFrame([(4, "second")], io.NOTES), path)
    io.append_notes(spark.createDataFrame([(5, "third"), (6, "line\nbreak")], io.NOTES).coalesce(1), path)
    assert sorted(map(tuple, io.read_notes(spark, path).collect())) == [(3, "Rollback target is v3.8.2"), (4, "second"), (5, "third"), (6, "line\nbreak")]
    (tmp_path / "store.json").write_text('[\n  {"turn": 1, "text": "a"},\n  {"turn": 2, "text": "b"}\n]')
    assert io.read_notes(spark, str(tmp_path / "store.json"), arrays=True).count() == 2
    (tmp_path / "p1.json").write_text('{"expected": {"totals": {"currency": "HKD", "total_billed": 1.5}}, "evidence": {"a.b": ["x", "y"]}}')
    truth = io.read_ground_truth(spark, str(tmp_path / "p1.json"))
    assert sorted(map(tuple, io.evidence(truth).collect())) == [("p1", "a.b", "x"), ("p1", "a.b", "y")]
    contexts = spark.createDataFrame([(1, 2, "s", 5, 5)], "conv_id long, request_id long, strategy string, slot_query long, tokens long")
    io.write_requests_csv(contexts, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["slot_memory"] == "0"
    io.write_rows_json(contexts, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
