"""Queries of call planning, coverage, cost, scoring and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from ..operators import pages as P
from ..operators import scoring as G
from ..operators import sessions as Z
from ..sources.scratch import written
from . import sqltext as S
from .pages_catalog import _CLASSIFIED, _ROUTES, INDEX, ROUTES, _classified, chunks, packs, read
from .sessions_catalog import PLAN, RENDER, SYSTEM, engineered_sql, messages, notes, requests

PROMPT = 300
FIELDS = {"o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date"}


def lenient_match(spark, sf_dir):
    """Orders rendered as text (long dates, thousands commas), every 7th key made wrong."""
    truth = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return G.score_scalars(truth, _rendered(truth), ["o_orderkey"], FIELDS)


def _rendered(truth):
    wrong = F.col("o_orderkey") % 7 == 0
    return truth.select(
        "o_orderkey", F.lower("o_orderstatus").alias("o_orderstatus"), F.concat(F.lit("HKD "), F.format_number(F.col("o_totalprice") + F.when(wrong, 1).otherwise(0), 2)).alias("o_totalprice"),
        F.date_format(F.date_add("o_orderdate", F.when(wrong, 1).otherwise(0)), "d MMMM yyyy").alias("o_orderdate"),
    )


def model_cost(spark, sf_dir):
    calls = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), T.token_count(F.col("text")).alias("tokens_in"), F.lit(100).cast("long").alias("tokens_out"))
    models = C.profiles(spark)
    costed = C.model_cost(calls.crossJoin(F.broadcast(models.select("model_key"))), models)
    return costed.select("call_id", "model_key", "tokens_in", "tokens_out", F.round("cost", 9).alias("cost"))


def reference_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    plain = G.reference_answers(rows, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])
    wrapped = G.reference_answers(rows, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"], True, {"o_custkey", "o_orderstatus"})
    return plain.select("o_orderkey", F.col("answer").alias("efficient")).join(wrapped.select("o_orderkey", F.col("answer").alias("wrapped")), "o_orderkey")


def plan_full(spark, sf_dir):
    return C.plan_full(packs(spark, sf_dir, "source"), C.profiles(spark), PROMPT)


def split_oversize_pages(spark, sf_dir):
    return C.split_oversize_pages(packs(spark, sf_dir), 1000).select("pack_id", "page_no", F.col("piece_no").cast("long").alias("piece_no"), "text", "tokens")


def chunk_packs(spark, sf_dir):
    return C.chunk_packs(packs(spark, sf_dir, "source"), C.profiles(spark), PROMPT)


def _routed(spark, sf_dir):
    return P.route_pages(_classified(spark, sf_dir), ROUTES)


def plan_routed(spark, sf_dir):
    planned = C.plan_routed(_routed(spark, sf_dir), packs(spark, sf_dir), sorted(ROUTES), C.profiles(spark), PROMPT)
    return planned.select("pack_id", "task", "model_key", "tokens_in", "max_out", "fits")


def _evidence(spark, sf_dir):
    """Every pack looks for all benchmark passages."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("field_key"), F.col("text").alias("phrase"))
    return packs(spark, sf_dir).select("pack_id").distinct().crossJoin(F.broadcast(items))


def _full_coverage(spark, sf_dir):
    calls = packs(spark, sf_dir).select("pack_id", F.col("page_no").alias("call_id"), "text")
    return C.covered_fields(calls, _evidence(spark, sf_dir))


def covered_fields(spark, sf_dir):
    return _full_coverage(spark, sf_dir).select("pack_id", "call_id", "field_key")


def final_coverage(spark, sf_dir):
    return C.final_coverage(_full_coverage(spark, sf_dir), ("pack_id",))


def missed_fields(spark, sf_dir):
    return C.missed_fields(_evidence(spark, sf_dir), final_coverage(spark, sf_dir))


#: Packs of calls are runs of so many pages, so that a pack's text stays small at any size of the table.
PACK_PAGES = 40
#: Which task owns which fields: ``group.sub`` keys by group.
GROUPS = {"western": {"a": None}, "central": {"b[]": None}, "any": {"c": ["2", "5", "8", "11", "14", "17", "20"]}}


def _bounded(pages):
    return pages.withColumn("pack_id", F.concat(F.lit("p"), F.floor(F.col("page_no") / PACK_PAGES).cast("string")))


def _keyed_evidence(spark, sf_dir):
    """All benchmark passages, under keys of three groups; without a pack_id, so every pack looks for all of them."""
    group = F.element_at(F.array(F.lit("a."), F.lit("b."), F.lit("c.")), (F.col("item_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select(F.concat(group, F.col("item_id").cast("string")).alias("field_key"), F.col("text").alias("phrase"))


def _both_pipelines(spark, sf_dir):
    models, evidence, raw = C.profiles(spark), _keyed_evidence(spark, sf_dir), _bounded(packs(spark, sf_dir))
    full = C.full_calls(raw, models, evidence, PROMPT)
    return full, C.routed_calls(_bounded(_routed(spark, sf_dir)), raw, evidence, GROUPS, models, PROMPT), models


def planned_calls(spark, sf_dir):
    full, routed, _ = _both_pipelines(spark, sf_dir)
    both = full.withColumn("pipeline", F.lit("full")).unionByName(routed.withColumn("pipeline", F.lit("routed")))
    return both.select("pack_id", "model_key", "pipeline", "call_no", "task", "tokens_in", "tokens_out", "max_out", "fits", F.array_join("covers", ",").alias("covers"))


def pipeline_report(spark, sf_dir):
    full, routed, models = _both_pipelines(spark, sf_dir)
    # Calls are read for their sizes and for their covers; their texts are not kept.
    full, routed = (written(c.drop("text")) for c in (full, routed))
    calls = full.withColumn("pipeline", F.lit("full")).unionByName(routed.withColumn("pipeline", F.lit("routed"))).select("pack_id", "model_key", "pipeline", "tokens_in", "tokens_out", "fits")
    return C.pipeline_report(calls, C.produced_fields(full, routed), models)


def counter_effect(spark, sf_dir):
    return C.counter_effect(read(spark, sf_dir, "documents").select(F.col("source").alias("sample"), "text"))


def _replies(spark, sf_dir):
    """Two attempts for each order: the first is broken for every 3rd key; fenced for even keys."""
    body = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("value"), F.lit(0.9).alias("confidence")).alias("custkey"), F.struct(F.col("o_orderstatus").alias("value"), F.lit(0.9).alias("confidence")).alias("status")))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), F.col("b"), F.lit("\n```"))).otherwise(F.concat(F.lit("Answer "), F.col("b"), F.lit(" done")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", body.alias("b")).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    broken = (F.col("attempt") == 1) & (F.col("o_orderkey") % 3 == 0)
    return rows.select(F.col("o_orderkey").alias("call_id"), "attempt", F.when(broken, "{ not json").otherwise(text).alias("text"))


_REPLY = "struct<custkey:struct<value:bigint,confidence:double>,status:struct<value:string,confidence:double>>"


def first_valid_reply(spark, sf_dir):
    valid = G.first_valid_reply(_replies(spark, sf_dir), _REPLY)
    valid = valid.withColumn("u", G.unwrap(F.col("reply"), valid.schema["reply"].dataType))
    return valid.select("call_id", F.col("attempt").cast("long").alias("attempt"), "attempts", F.col("u.custkey").alias("custkey"), F.col("u.status").alias("status"))


def merge_task_results(spark, sf_dir):
    parts = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"), F.lit("item").alias("grp"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").cast("long").alias("task_no"), F.col("l_linestatus").alias("value")
    )
    return G.merge_task_results(parts)


def usage_report(spark, sf_dir):
    rows = _replies(spark, sf_dir).where("attempt = 1 or call_id % 3 = 0")
    usage = rows.select(
        F.when(F.col("call_id") % 5 == 0, "full").otherwise("routed").alias("pipeline"), "attempt", T.token_count(F.col("text")).alias("tokens_in"), F.lit(50).cast("long").alias("tokens_out"),
        (F.col("call_id") % 10).cast("long").alias("reasoning_tokens"), F.when(F.col("call_id") % 7 == 0, 0).otherwise(2).cast("long").alias("correct"),
    )
    missed = rows.where("call_id % 7 = 0").select(F.when(F.col("call_id") % 5 == 0, "full").otherwise("routed").alias("pipeline"), F.concat(F.lit("key"), (F.col("call_id") % 70).cast("string")).alias("field_key"))
    return G.usage_report(usage, missed=missed)


def _invoices(spark, sf_dir, wrong=False):
    """Lines of an order as its invoices; every 11th amount is wrong where asked."""
    amount = F.col("l_extendedprice").cast("double")
    if wrong:
        amount = amount + F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0, 5).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pack_id"), F.concat_ws("-", F.lit("INV"), "l_linenumber", "l_partkey", "l_suppkey").alias("invoice_number"), amount.alias("amount"))


def _superseded(spark, sf_dir):
    """Read from letters: every 4th order has one that replaces its second invoice."""
    letters = _invoices(spark, sf_dir).where("pack_id % 4 = 0 and invoice_number like 'INV-2-%'")
    text = F.concat(F.lit("Dear member,\nInvoice NEW-"), F.col("pack_id").cast("string"), F.lit(" replaces "), "invoice_number", F.lit(". Invoices replaced before stay so."))
    return G.supersessions(letters.select("pack_id", text.alias("text"))).select("pack_id", "invoice_number")


def supersessions(spark, sf_dir):
    return _superseded(spark, sf_dir)


def input_budgets(spark, sf_dir):
    """What each model's window leaves for input, less a margin and the answer, and whether a source's texts fit it."""
    models = C.profiles(spark).select("model_key", T.input_budget(F.col("context_window"), F.lit(0.05), F.col("max_out")).alias("input_budget"))
    sizes = packs(spark, sf_dir, "source").groupBy("pack_id").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"))
    return sizes.crossJoin(F.broadcast(models)).select("pack_id", "model_key", "input_budget", "tokens", (F.col("tokens") <= F.col("input_budget")).alias("fits"))


def _listed(df):
    return df.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("invoice_number", "amount"))).alias("invoices"))


def score_fields(spark, sf_dir):
    return G.score_invoices(_listed(_invoices(spark, sf_dir)), _listed(_invoices(spark, sf_dir, True)), _superseded(spark, sf_dir))


#: Codes that are accepted for others.
SYNONYMS = {"K1": ["K7", "k-8"], "K2": ["K9"]}


def _claims(spark, sf_dir, got=False):
    """An order as a claim: its status and price, its lines as diagnoses (the first is primary), procedures and invoices.

    As extracted, every 5th order's diagnoses are all unmarked and lower-cased, every 3rd line's procedure is written by another code."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("K"), (F.col("l_partkey") % 10).cast("string")).alias("code"),
        F.concat_ws("-", F.lit("INV"), "l_linenumber", "l_partkey", "l_suppkey").alias("invoice_number"), F.col("l_extendedprice").cast("double").alias("amount"),
    )
    fifth, third = F.col("pack_id") % 5 == 0, F.col("n") % 3 == 0
    diagnosis = F.concat(F.lit("D"), F.col("n").cast("string"), F.lit("."), F.col("code"))
    if got:
        lines = lines.withColumn("amount", F.col("amount") + F.when((F.col("pack_id") + F.col("n")) % 11 == 0, 5).otherwise(0))
        diagnosis = F.when(fifth, F.lower(diagnosis)).otherwise(diagnosis)
        procedure = F.when(third & (F.col("code") == "K1"), "K8").when(third & (F.col("code") == "K2"), "K3").otherwise(F.col("code"))
    else:
        procedure = F.col("code")
    primary = (F.col("n") == 1) & ~(fifth & F.lit(got))
    listed = lines.groupBy("pack_id").agg(
        F.array_sort(F.collect_list(F.struct(diagnosis.alias("icd10"), primary.alias("primary")))).alias("diagnoses"), F.array_sort(F.collect_set(F.struct(procedure.alias("code")))).alias("procedures"),
        F.array_sort(F.collect_list(F.struct("invoice_number", "amount"))).alias("invoices"),
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("total"))
    if got:
        orders = orders.withColumn("total", F.format_number(F.col("total") + F.when(F.col("pack_id") % 7 == 0, 1).otherwise(0), 2))
    return orders.join(listed, "pack_id")


def score_claims(spark, sf_dir):
    scored = G.score_fields(
        _claims(spark, sf_dir), _claims(spark, sf_dir, True), _superseded(spark, sf_dir), {"status": "text", "total": "number"},
        {"diagnoses": ("icd10", "primary", None), "procedures": ("code", None, SYNONYMS)},
    )
    return scored.select("pack_id", "field_key", "correct")


def current_invoice_totals(spark, sf_dir):
    approved = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_totalprice").cast("double").alias("approved_amount"))
    money = _invoices(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return G.current_invoice_totals(money, _superseded(spark, sf_dir), approved)


#: The request that a new session makes: the same question, no history.
NEW_SESSION = -1


def _asked(spark, sf_dir):
    """All requests, and for each session its last question once more in a new session, which sees notes only."""
    asked = requests(spark, sf_dir)
    last = asked.groupBy("conv_id").agg(F.max_by("query", "request_id").alias("query"))
    fresh = last.select("conv_id", F.lit(NEW_SESSION).cast(asked.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast(asked.schema["as_of"].dataType).alias("as_of"), F.lit(False).alias("inclusive"), "query")
    return asked.unionByName(fresh)


def _facts(spark, sf_dir):
    """A session's requests ask for the first sentence of each of its messages of turns 0 and 1."""
    told = messages(spark, sf_dir).where("turn < 2").select("conv_id", T.summary_sentences(F.col("content")).alias("s")).where(F.size("s") > 0)
    return told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("s")[0])).alias("must_contain"))


def _contexts(spark, sf_dir, carried=()):
    """All seven strategies, with text where the budget holds, and the facts that a request asks for where they are ``carried``."""
    asked, told, kb = _asked(spark, sf_dir), messages(spark, sf_dir), chunks(spark, sf_dir)
    if carried:
        asked = asked.join(_facts(spark, sf_dir), "conv_id", "left")
    return Z.all_contexts(told, asked, notes(spark, sf_dir), kb, PLAN, SYSTEM, carried)


def _checked(spark, sf_dir):
    """The contexts, judged by their text; ``asked`` is false where there is no fact to look for."""
    contexts = _contexts(spark, sf_dir, ("must_contain",))
    kept = contexts.select("conv_id", "request_id", "strategy", "tokens", "compactions", "text", "must_contain", F.col("must_contain").isNotNull().alias("asked"), (F.col("tokens") <= PLAN.budget).alias("within"))
    # Summed and checked: built once, and without the texts, which are far longer than what they are read for.
    return written(G.judged(kept))


def fact_checks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("pack_id"), "doc_id", "text", (F.length("text") < 20000).alias("within"))
    items = read(spark, sf_dir, "benchmark").select("item_id", T.summary_sentences(F.col("text")).alias("must_contain"))
    asked = items.crossJoin(F.broadcast(spark.createDataFrame([("en",), ("de",), ("fr",), ("es",)], "pack_id string")))
    return G.fact_hits(docs, asked, ("pack_id",), ("doc_id",), ("item_id",))


def answer_check(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", T.summary_sentences(F.col("text")).alias("must_contain"))
    told = F.when(F.col("qid") % 3 == 0, F.element_at("must_contain", 1)).otherwise(F.lower("text"))
    return G.answer_check(items.select("qid", told.alias("answer")), items.select("qid", "must_contain"))


def strategy_summary(spark, sf_dir):
    contexts, fresh = _checked(spark, sf_dir), F.col("request_id") == NEW_SESSION
    checks = contexts.where("asked")
    return G.strategy_summary(contexts.where(~fresh), checks.where(~fresh), PLAN.budget, checks.where(fresh))


def question_matrix(spark, sf_dir):
    checks = _checked(spark, sf_dir).where("asked").withColumn("qid", F.concat_ws(":", "conv_id", "request_id"))
    kind = F.when(F.col("request_id") == NEW_SESSION, "new session").otherwise("in session")
    return G.question_matrix(checks.withColumn("kind", kind), list(Z.STRATEGIES), ("qid", "kind"))


QUERIES = {
    f.__name__: f
    for f in (
        lenient_match, model_cost, reference_answers, plan_full, split_oversize_pages, chunk_packs, plan_routed, covered_fields, final_coverage, missed_fields, pipeline_report, counter_effect, first_valid_reply,
        merge_task_results, usage_report, score_fields, score_claims, planned_calls, supersessions, input_budgets, current_invoice_totals, fact_checks, answer_check, strategy_summary, question_matrix,
    )
}

_PROFILES = "profiles AS (SELECT *, least(4096, context_window // 4)::BIGINT AS max_out FROM (VALUES " + ", ".join(
    f"('{k}', '{label}', {w}::BIGINT, {'NULL' if i is None else i}::DOUBLE, {'NULL' if o is None else o}::DOUBLE)" for k, label, w, i, o in C.PROFILES
) + ") v(model_key, label, context_window, price_in, price_out))"
_WS = lambda x: rf"regexp_replace({x}, '\s+', ' ', 'g')"
_COVERED = f"covered AS (SELECT lang AS pack_id, doc_id AS call_id, 'item' || item_id AS field_key FROM documents d, benchmark b WHERE contains({_WS('d.text')}, {_WS('b.text')}))"
_REPLIES = """replies AS (SELECT o_orderkey AS call_id, a AS attempt, CASE WHEN a = 1 AND o_orderkey % 3 = 0 THEN '{ not json' WHEN o_orderkey % 2 = 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || b || chr(10) || '```'
  ELSE 'Answer ' || b || ' done' END AS text, o_custkey, o_orderstatus FROM (SELECT *, '{"custkey":{"value":' || o_custkey || ',"confidence":0.9},"status":{"value":"' || o_orderstatus || '","confidence":0.9}}' AS b FROM orders), (VALUES (1), (2)) v(a))"""
_INV = "inv AS (SELECT l_orderkey AS pack_id, 'INV-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS invoice_number, l_extendedprice::DOUBLE AS amount, l_extendedprice::DOUBLE + CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 5 ELSE 0 END AS got FROM lineitem)"


def _pieces(by: str, source: str) -> str:
    """Recursive next-fit of lines (page over room) then of pieces (pack)."""
    return f"""pg AS MATERIALIZED (SELECT {by} AS pack_id, doc_id AS page_no, coalesce(text, '') AS text, {S.tokens("coalesce(text, '')")} AS whole, model_key, room FROM documents, {source}),
ln AS MATERIALIZED (SELECT pack_id, page_no, model_key, room, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT *, CASE WHEN whole > room THEN string_split(text, chr(10)) ELSE [text] END AS ls FROM pg)),
lt AS MATERIALIZED (SELECT *, {S.tokens('l')} AS t FROM ln),
lw AS (SELECT pack_id, page_no, model_key, i, room, 0 AS piece_no, t AS used FROM lt WHERE i = 1 UNION ALL
  SELECT c.pack_id, c.page_no, c.model_key, c.i, c.room, CASE WHEN w.used + c.t > c.room THEN w.piece_no + 1 ELSE w.piece_no END, CASE WHEN w.used + c.t > c.room THEN c.t ELSE w.used + c.t END
  FROM lw w JOIN lt c ON c.pack_id = w.pack_id AND c.page_no = w.page_no AND c.model_key = w.model_key AND c.i = w.i + 1),
pieces AS MATERIALIZED (SELECT pack_id, page_no, model_key, any_value(lt.room) AS room, piece_no, string_agg(l, chr(10) ORDER BY i) AS text, sum(t)::BIGINT AS tokens FROM lt JOIN lw USING (pack_id, page_no, model_key, i) GROUP BY pack_id, page_no, model_key, piece_no)"""


_KEY = "CASE item_id % 3 WHEN 0 THEN 'a.' WHEN 1 THEN 'b.' ELSE 'c.' END || item_id"
_PACK = f"'p' || (doc_id // {PACK_PAGES})"
_LEAF = {
    True: S.tokens("""'"' || field_key || '":{"value":"' || phrase || '","source_quote":"' || phrase || '","confidence":0.95},'"""),
    False: S.tokens("""'"' || field_key || '":"' || phrase || '",'"""),
}
_DOC = S.tokens("'<doc type=' || chr(34) || kind || chr(34) || ' page=' || chr(34) || page_no || chr(34) || '>' || chr(10) || text || chr(10) || '</doc>'")
_OVER = PROMPT + C.FRAME
_OWNED = " OR ".join(f"task = '{t}' AND split_part(field_key, '.', 1) = '{g.removesuffix('[]')}'" + ("" if only is None else f" AND split_part(field_key, '.', 2) IN ({', '.join(repr(x) for x in only)})") for t, owns in GROUPS.items() for g, only in owns.items())
_CALLS = f"""WITH RECURSIVE {_PROFILES}, sized AS (SELECT *, context_window - max_out - {_OVER} AS room FROM profiles), {_pieces(_PACK, 'sized')},
ev AS (SELECT {_KEY} AS field_key, text AS phrase, {_WS('text')} AS p FROM benchmark),
pk0 AS (SELECT {_PACK} AS pack_id, sum({S.tokens("coalesce(text, '')")})::BIGINT AS t, {_WS("string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id)")} AS body FROM documents GROUP BY ALL),
planned AS MATERIALIZED (SELECT pack_id, model_key, room, max_out, context_window, t, t <= room AS one FROM pk0, sized),
pk AS MATERIALIZED (SELECT pieces.*, row_number() OVER (PARTITION BY pack_id, model_key ORDER BY page_no, piece_no) AS k FROM pieces JOIN planned USING (pack_id, model_key) WHERE NOT one AND planned.room >= {C.LEAST_ROOM}),
pw AS (SELECT pack_id, model_key, k, 1 AS c, tokens AS used FROM pk WHERE k = 1 UNION ALL
  SELECT p.pack_id, p.model_key, p.k, CASE WHEN w.used + p.tokens > p.room THEN w.c + 1 ELSE w.c END, CASE WHEN w.used + p.tokens > p.room THEN p.tokens ELSE w.used + p.tokens END
  FROM pw w JOIN pk p ON p.pack_id = w.pack_id AND p.model_key = w.model_key AND p.k = w.k + 1),
ch AS MATERIALIZED (SELECT pack_id, model_key, c::BIGINT AS call_no, sum(tokens)::BIGINT AS t, {_WS("string_agg(text, chr(10) || chr(10) ORDER BY k)")} AS body FROM pk JOIN pw USING (pack_id, model_key, k) GROUP BY ALL),
cov AS MATERIALIZED (SELECT pack_id, model_key, call_no, field_key, {_LEAF[True]} AS leaf FROM ch, ev WHERE contains(body, p)),
cova AS (SELECT pack_id, field_key, {_LEAF[True]} AS leaf FROM pk0, ev WHERE contains(body, p)),
told AS (SELECT ch.pack_id, ch.model_key, ch.call_no, any_value(t) AS t, coalesce(1 + sum(leaf), {C.EMPTY_ANSWER})::BIGINT AS tokens_out, coalesce(string_agg(field_key, ',' ORDER BY field_key), '') AS covers
  FROM ch LEFT JOIN cov USING (pack_id, model_key, call_no) GROUP BY ALL),
un AS (SELECT DISTINCT pack_id, model_key, field_key, leaf FROM cov),
unl AS (SELECT pack_id, model_key, 1 + sum(leaf) AS o, string_agg(field_key, ',' ORDER BY field_key) AS covers FROM un GROUP BY ALL),
mg AS (SELECT pack_id, model_key, max(call_no) + 1 AS call_no, sum(tokens_out)::BIGINT AS t FROM told GROUP BY ALL),
direct AS (SELECT pack_id, model_key, any_value(t) AS t, coalesce(1 + sum(leaf), {C.EMPTY_ANSWER})::BIGINT AS tokens_out, coalesce(string_agg(field_key, ',' ORDER BY field_key), '') AS covers
  FROM planned LEFT JOIN cova USING (pack_id) WHERE one GROUP BY ALL),
fc AS (SELECT pack_id, model_key, 1::BIGINT AS call_no, 'all' AS task, t, tokens_out, covers, true AS ok FROM direct
  UNION ALL SELECT pack_id, model_key, 1, 'no_room', t, {C.EMPTY_ANSWER}, '', false FROM planned WHERE NOT one AND room < {C.LEAST_ROOM}
  UNION ALL SELECT pack_id, model_key, call_no, 'chunk ' || call_no, t, tokens_out, covers, true FROM told
  UNION ALL SELECT pack_id, model_key, call_no, 'merge', t, coalesce(o, {C.EMPTY_ANSWER})::BIGINT, coalesce(unl.covers, ''), true FROM mg LEFT JOIN unl USING (pack_id, model_key)),
fullc AS (SELECT pack_id, model_key, 'full' AS pipeline, call_no, task, t + {_OVER} AS tokens_in, tokens_out, max_out, ok AND t + {_OVER} + max_out <= context_window AS fits, covers FROM fc JOIN profiles USING (model_key)),
{_CLASSIFIED.replace('pages AS', 'lpages AS').replace('FROM pages', 'FROM lpages')}, {_ROUTES},
rp AS MATERIALIZED (SELECT 'p' || (page_no // {PACK_PAGES}) AS pack_id, task, page_no, {_DOC} AS t, '<doc type=' || chr(34) || kind || chr(34) || ' page=' || chr(34) || page_no || chr(34) || '>' || chr(10) || text || chr(10) || '</doc>' AS r
  FROM classified JOIN routes USING (kind) WHERE dropped_reason IS NULL),
rt AS MATERIALIZED (SELECT pack_id, task, sum(t)::BIGINT AS t, {_WS("string_agg(r, chr(10) ORDER BY page_no)")} AS body FROM rp GROUP BY ALL),
tk AS (SELECT DISTINCT task FROM routes),
own AS (SELECT task, field_key, p, {_LEAF[False]} AS leaf FROM tk, ev WHERE {_OWNED}),
osz AS (SELECT task, 1 + sum(leaf) AS o FROM own GROUP BY task),
rcov AS (SELECT pack_id, task, string_agg(field_key, ',' ORDER BY field_key) AS covers FROM rt JOIN own USING (task) WHERE contains(body, p) GROUP BY ALL),
routedc AS (SELECT pk0.pack_id, model_key, 'routed' AS pipeline, (row_number() OVER (PARTITION BY pk0.pack_id, model_key ORDER BY tk.task))::BIGINT AS call_no, tk.task, coalesce(rt.t, 0) + {_OVER} AS tokens_in,
  coalesce(o, {C.EMPTY_ANSWER})::BIGINT AS tokens_out, {C.ROUTED_OUT}::BIGINT AS max_out, coalesce(rt.t, 0) + {_OVER + C.ROUTED_OUT} <= context_window AS fits, coalesce(covers, '') AS covers
  FROM pk0 CROSS JOIN tk CROSS JOIN profiles LEFT JOIN rt ON rt.pack_id = pk0.pack_id AND rt.task = tk.task LEFT JOIN osz ON osz.task = tk.task LEFT JOIN rcov ON rcov.pack_id = pk0.pack_id AND rcov.task = tk.task),
calls AS MATERIALIZED (SELECT * FROM fullc UNION ALL SELECT * FROM routedc)"""


_TOLD = lambda tag, text: f"CASE WHEN {text} <> '' THEN '<{tag}>' || chr(10) || {text} || chr(10) || '</{tag}>' END"
_SIZE = Z._heuristic(SYSTEM)
_SYSTEM = "'" + SYSTEM.replace("'", "''") + "'"
#: Contexts of all strategies, for all requests and each session's last question in a new session; with their text where the budget holds.
_CONTEXTS = f"""WITH RECURSIVE {INDEX}, m AS MATERIALIZED ({S.MESSAGES}), r0 AS MATERIALIZED ({S.REQUESTS}),
r AS MATERIALIZED (SELECT * FROM r0 UNION ALL SELECT conv_id, {NEW_SESSION}, NULL, false, max_by(query, request_id) FROM r0 GROUP BY conv_id), n AS ({S.NOTES}),
{engineered_sql(_SIZE)},
kb AS MATERIALIZED (SELECT *, sum(tokens + 12) OVER (ORDER BY doc_id, chunk_no) AS running FROM (SELECT doc_id, chunk_no, tokens, {S.tokens(RENDER)} AS t, {RENDER} AS body FROM chunks)),
kb_all AS (SELECT coalesce(sum(t), 0)::BIGINT AS t, string_agg(body, chr(10) ORDER BY running) FILTER (running <= {PLAN.budget}) AS body FROM kb),
kb_share AS (SELECT coalesce(sum(t), 0)::BIGINT AS t, coalesce(string_agg(body, chr(10) ORDER BY running), '') AS body FROM kb WHERE running <= {int(PLAN.budget * PLAN.kb_share)}),
hist AS MATERIALIZED (SELECT rq.conv_id, request_id, query, slot_query, ms, CASE WHEN as_of IS NULL THEN 0 ELSE len(list_filter(ms, lambda x: x.turn < as_of)) END AS vis FROM rq LEFT JOIN ml USING (conv_id)),
lengths AS MATERIALIZED (SELECT *, coalesce(list_sum(list_transform(ms[1:vis], lambda x: x.tok)), 0)::BIGINT AS history FROM hist),
cut_at AS (SELECT l.*, kb_share.t AS kb, kb_share.body AS documents, coalesce(len(list_filter(range(1, vis + 1), lambda i: history - list_sum(list_transform(ms[1:i], lambda x: x.tok)) > {PLAN.budget} - {_SIZE} - {Z.WRAP} - kb_share.t - slot_query)), 0)
  + (history > {PLAN.budget} - {_SIZE} - {Z.WRAP} - kb_share.t - slot_query)::BIGINT AS gone FROM lengths l, kb_share),
truncated AS (SELECT *, least(gone, vis) AS first_seq, coalesce(list_sum(list_transform(ms[least(gone, vis) + 1:vis], lambda x: x.tok)), 0)::BIGINT AS kept FROM cut_at),
contexts0 AS MATERIALIZED (
  SELECT conv_id, request_id, strategy, tokens, compactions, query, memory, documents, summary, array_to_string(list_transform(shown, lambda x: CASE WHEN clearing AND x.tool AND x.nth <= tools - {PLAN.keep_tools} THEN x.cut ELSE x.raw END), chr(10) || chr(10)) AS said FROM built
  UNION ALL SELECT conv_id, request_id, 'truncated', {_SIZE} + kb + kept + CASE WHEN kept > 0 THEN {Z.TAG_TOKENS['conversation']} ELSE 0 END + slot_query, 0, query, '', documents, '', array_to_string(list_transform(ms[first_seq + 1:vis], lambda x: x.raw), chr(10) || chr(10)) FROM truncated
  UNION ALL SELECT conv_id, request_id, 'unbounded', {_SIZE} + kb_all.t + history + CASE WHEN vis > 0 THEN {Z.TAG_TOKENS['conversation']} ELSE 0 END + slot_query, 0, query, '', coalesce(kb_all.body, ''), '', array_to_string(list_transform(ms[1:vis], lambda x: x.raw), chr(10) || chr(10)) FROM lengths, kb_all),
contexts AS MATERIALIZED (SELECT *, CASE WHEN tokens <= {PLAN.budget} THEN concat_ws(chr(10) || chr(10), {_SYSTEM}, nullif(memory, ''), nullif(documents, ''), {_TOLD('conversation_summary', 'summary')}, {_TOLD('conversation', "coalesce(said, '')")}, {_TOLD('current_request', 'query')}) END AS text FROM contexts0),
facts AS (SELECT conv_id, list(s) AS must FROM (SELECT conv_id, ({S.sentences('content')})[1] AS s FROM m WHERE turn < 2) WHERE s IS NOT NULL GROUP BY conv_id),
checks AS MATERIALIZED (SELECT conv_id, request_id, strategy, tokens <= {PLAN.budget} AS within, coalesce(len(list_filter(must, lambda f: contains(text, f))) = len(must), false) AND text IS NOT NULL AND tokens <= {PLAN.budget} AS answerable FROM contexts JOIN facts USING (conv_id))"""

ORACLE_SQL = {
    "strategy_summary": f"""{_CONTEXTS}, sums AS (SELECT strategy, count(*) AS requests, sum(tokens)::BIGINT AS total, round_even(avg(tokens), 0)::BIGINT AS mean, max(tokens)::BIGINT AS peak, count(*) FILTER (tokens > {PLAN.budget}) AS over FROM contexts WHERE request_id <> {NEW_SESSION} GROUP BY strategy),
comp AS (SELECT strategy, sum(c)::BIGINT AS compactions FROM (SELECT conv_id, strategy, max(compactions) AS c FROM contexts WHERE request_id <> {NEW_SESSION} GROUP BY ALL) GROUP BY strategy),
asks AS (SELECT strategy, count(*) FILTER (request_id <> {NEW_SESSION}) AS questions, count(*) FILTER (answerable AND request_id <> {NEW_SESSION}) AS answerable,
  count(*) FILTER (answerable AND request_id = {NEW_SESSION}) || '/' || count(*) FILTER (request_id = {NEW_SESSION}) AS new_session FROM checks GROUP BY strategy)
SELECT sums.*, compactions, questions, answerable, CASE WHEN questions > 0 THEN round_even(100 * answerable / questions, 1) ELSE 0 END AS answerable_pct, new_session FROM sums JOIN comp USING (strategy) JOIN asks USING (strategy)""",
    "question_matrix": f"""{_CONTEXTS}, cells AS (SELECT conv_id || ':' || request_id AS qid, CASE WHEN request_id = {NEW_SESSION} THEN 'new session' ELSE 'in session' END AS kind, strategy, CASE WHEN NOT within THEN 'over' WHEN answerable THEN 'yes' ELSE '-' END AS cell FROM checks)
SELECT qid, kind, {', '.join(f"any_value(cell) FILTER (strategy = '{k}') AS {k}" for k in Z.STRATEGIES)} FROM cells GROUP BY qid, kind""",
    "supersessions": f"WITH {_INV} SELECT DISTINCT pack_id, invoice_number FROM inv WHERE pack_id % 4 = 0 AND invoice_number LIKE 'INV-2-%'",
    "input_budgets": f"""WITH {_PROFILES}, p AS (SELECT source AS pack_id, sum({S.tokens('text')})::BIGINT AS tokens FROM documents GROUP BY source)
SELECT pack_id, model_key, (floor(context_window * 0.95::DOUBLE) - max_out)::BIGINT AS input_budget, tokens, tokens <= floor(context_window * 0.95::DOUBLE) - max_out AS fits FROM p, profiles""",
    "planned_calls": f"{_CALLS} SELECT * FROM calls",
    "pipeline_report": f"""{_CALLS}, pks AS (SELECT pack_id, model_key, pipeline, bool_and(fits) AS fits, count(*) AS calls, sum(tokens_in) AS ti, sum(tokens_out) AS tout FROM calls GROUP BY ALL),
made AS (SELECT pack_id, model_key, pipeline, covers FROM calls WHERE pipeline = 'routed' UNION ALL SELECT pack_id, model_key, pipeline, max_by(covers, call_no) FROM calls WHERE pipeline = 'full' GROUP BY ALL),
fld AS (SELECT pack_id, model_key, pipeline, count(DISTINCT f) AS fields FROM (SELECT *, unnest(string_split(covers, ',')) AS f FROM made WHERE covers <> '') GROUP BY ALL),
pf AS MATERIALIZED (SELECT pks.*, coalesce(fields, 0) AS fields FROM pks LEFT JOIN fld USING (pack_id, model_key, pipeline)),
sm AS (SELECT model_key, pipeline, count(*) AS packs, count(*) FILTER (NOT fits) AS failed, coalesce(sum(calls) FILTER (fits), 0)::BIGINT AS calls, coalesce(sum(ti) FILTER (fits), 0)::BIGINT AS tokens_in, coalesce(sum(tout) FILTER (fits), 0)::BIGINT AS tokens_out,
  coalesce(sum(fields) FILTER (fits), 0)::BIGINT AS fields FROM pf GROUP BY ALL),
sv AS (SELECT a.model_key, a.pipeline, round(1 - sum(a.ti + a.tout) / sum(b.ti + b.tout), 6) AS saving FROM pf a JOIN pf b ON a.pack_id = b.pack_id AND a.model_key = b.model_key AND b.pipeline = 'full' WHERE a.fits AND b.fits GROUP BY ALL)
SELECT model_key, pipeline, packs, failed, calls, tokens_in, tokens_out, tokens_in + tokens_out AS tokens, round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6) AS cost, fields,
  CASE WHEN tokens_in + tokens_out > 0 THEN round_even(1000 * fields / (tokens_in + tokens_out), 3) ELSE 0 END AS fields_per_1k, saving FROM sm JOIN profiles USING (model_key) LEFT JOIN sv USING (model_key, pipeline)""",
    "score_claims": f"""WITH {_INV.replace('inv AS', 'inv0 AS')}, l AS (SELECT l_orderkey AS pack_id, l_linenumber AS n, 'K' || l_partkey % 10 AS code FROM lineitem),
e AS (SELECT DISTINCT pack_id, code FROM l), g AS (SELECT DISTINCT pack_id, CASE WHEN n % 3 = 0 AND code = 'K1' THEN 'K8' WHEN n % 3 = 0 AND code = 'K2' THEN 'K3' ELSE code END AS code FROM l),
ok(code, fit) AS (VALUES ('K1', 'K7'), ('K1', 'K8'), ('K2', 'K9'))
SELECT o_orderkey AS pack_id, 'status' AS field_key, true AS correct FROM orders WHERE o_orderkey IN (SELECT pack_id FROM l) UNION ALL SELECT o_orderkey, 'total', o_orderkey % 7 <> 0 FROM orders WHERE o_orderkey IN (SELECT pack_id FROM l)
UNION ALL SELECT pack_id, 'diagnoses.D' || n || '.' || code, NOT (n = 1 AND pack_id % 5 = 0) FROM l
UNION ALL SELECT pack_id, 'procedures.' || code, EXISTS (SELECT 1 FROM g WHERE g.pack_id = e.pack_id AND (g.code = e.code OR EXISTS (SELECT 1 FROM ok WHERE ok.code = e.code AND ok.fit = g.code))) FROM e
UNION ALL SELECT pack_id, 'invoices.' || invoice_number, bool_or(abs(got - amount) < 0.01) FROM inv0 GROUP BY ALL
UNION ALL SELECT pack_id, 'invoices.no_superseded', NOT bool_or(pack_id % 4 = 0 AND invoice_number LIKE 'INV-2-%') FROM inv0 GROUP BY pack_id""",
    "lenient_match": """WITH g AS (SELECT *, o_orderkey % 7 = 0 AS bad FROM orders)
SELECT o_orderkey, unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate']) AS field_key, unnest([true, NOT bad, NOT bad]) AS correct FROM g""",
    "model_cost": f"""WITH {_PROFILES} SELECT doc_id AS call_id, model_key, {S.tokens('text')} AS tokens_in, 100::BIGINT AS tokens_out, round(({S.tokens('text')} * price_in + 100 * price_out) / 1e6, 9) AS cost FROM documents, profiles""",
    "reference_answers": """SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' AS efficient,
'{"o_custkey":{"value":' || o_custkey || ',"source_quote":"' || o_custkey || '","confidence":0.95},"o_orderstatus":{"value":"' || o_orderstatus || '","source_quote":"' || o_orderstatus || '","confidence":0.95}}' AS wrapped FROM orders""",
    "plan_full": f"""WITH {_PROFILES}, p AS (SELECT source AS pack_id, sum({S.tokens('text')})::BIGINT + {PROMPT + C.FRAME} AS tokens_in FROM documents GROUP BY source)
SELECT pack_id, model_key, tokens_in, max_out, tokens_in + max_out <= context_window AS fits FROM p, profiles""",
    "split_oversize_pages": f"WITH RECURSIVE one AS (SELECT 'x' AS model_key, 1000 AS room), {_pieces('lang', 'one')} SELECT pack_id, page_no, piece_no::BIGINT AS piece_no, text, tokens FROM pieces",
    "chunk_packs": f"""WITH RECURSIVE {_PROFILES}, sized AS (SELECT *, context_window - max_out - {PROMPT} AS room FROM profiles), {_pieces('source', 'sized')},
pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pack_id, model_key ORDER BY page_no, piece_no) AS k FROM pieces),
pw AS (SELECT pack_id, model_key, k, 0 AS c, tokens AS used FROM pk WHERE k = 1 UNION ALL
  SELECT p.pack_id, p.model_key, p.k, CASE WHEN w.used + p.tokens > p.room THEN w.c + 1 ELSE w.c END, CASE WHEN w.used + p.tokens > p.room THEN p.tokens ELSE w.used + p.tokens END
  FROM pw w JOIN pk p ON p.pack_id = w.pack_id AND p.model_key = w.model_key AND p.k = w.k + 1),
ch AS (SELECT pack_id, model_key, c, sum(tokens)::BIGINT AS t FROM pk JOIN pw USING (pack_id, model_key, k) GROUP BY ALL),
tot AS (SELECT pack_id, model_key, count(*) AS n_chunks, (sum(t) + count(*) * {PROMPT})::BIGINT AS ci, sum(ceil(t * 0.1))::BIGINT AS co FROM ch GROUP BY ALL)
SELECT pack_id, model_key, CASE WHEN n_chunks <= 1 THEN 'one_call' WHEN co + {PROMPT} + max_out > context_window THEN 'merge_too_big' ELSE 'merged' END AS status, n_chunks,
  ci + CASE WHEN n_chunks > 1 THEN co + {PROMPT} ELSE 0 END AS tokens_in, co + CASE WHEN n_chunks > 1 THEN co ELSE 0 END AS tokens_out, CASE WHEN n_chunks > 1 THEN co + {PROMPT} END AS merge_in FROM tot JOIN profiles USING (model_key)""",
    "plan_routed": f"""WITH {_CLASSIFIED}, {_ROUTES}, {_PROFILES}, tp AS (SELECT DISTINCT lang AS pack_id, task FROM documents, routes),
rd AS (SELECT pack_id, task, sum({S.tokens("'<doc type=" + chr(34) + "' || kind || '" + chr(34) + " page=" + chr(34) + "' || page_no || '" + chr(34) + ">' || chr(10) || text || chr(10) || '</doc>'")})::BIGINT AS t
  FROM classified JOIN routes USING (kind) WHERE dropped_reason IS NULL GROUP BY ALL)
SELECT pack_id, task, model_key, coalesce(t, 0) + {PROMPT + C.FRAME} AS tokens_in, {C.ROUTED_OUT}::BIGINT AS max_out, coalesce(t, 0) + {PROMPT + C.FRAME + C.ROUTED_OUT} <= context_window AS fits FROM tp LEFT JOIN rd USING (pack_id, task), profiles""",
    "covered_fields": f"WITH {_COVERED} SELECT * FROM covered",
    "final_coverage": f"WITH {_COVERED} SELECT DISTINCT pack_id, field_key FROM covered",
    "missed_fields": f"WITH {_COVERED} SELECT pack_id, field_key FROM (SELECT DISTINCT lang AS pack_id FROM documents), (SELECT 'item' || item_id AS field_key FROM benchmark) EXCEPT SELECT pack_id, field_key FROM covered",
    "counter_effect": f"""SELECT sample, heuristic, chars4, words, round(chars4 / heuristic, 6) AS chars4_ratio, round(words / heuristic, 6) AS words_ratio FROM (SELECT source AS sample, sum({S.tokens('text')})::BIGINT AS heuristic,
  sum(ceil(length(text) / 4.0))::BIGINT AS chars4, sum(len(regexp_extract_all(text, '[^\\s]+')))::BIGINT AS words FROM documents GROUP BY source)""",
    "first_valid_reply": """SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS attempt, 2::BIGINT AS attempts, o_custkey AS custkey, o_orderstatus AS status FROM orders""",
    "merge_task_results": "SELECT l_orderkey AS pack_id, 'item' AS grp, l_returnflag AS field, max_by(l_linestatus, l_linenumber * 1000 + ascii(l_linestatus)) AS value FROM lineitem GROUP BY ALL",
    "usage_report": f"""WITH {_REPLIES}, u AS (SELECT *, CASE WHEN call_id % 5 = 0 THEN 'full' ELSE 'routed' END AS pipeline, {S.tokens('text')} AS tin FROM replies WHERE attempt = 1 OR call_id % 3 = 0),
s AS (SELECT pipeline, sum(tin)::BIGINT AS tokens_in, (50 * count(*))::BIGINT AS tokens_out, sum(call_id % 10)::BIGINT AS reasoning_tokens, count(*) FILTER (attempt > 1) AS retries, sum(CASE WHEN call_id % 7 = 0 THEN 0 ELSE 2 END)::BIGINT AS correct FROM u GROUP BY ALL),
k AS (SELECT pipeline, string_agg(key, ',' ORDER BY key) AS missed FROM (SELECT DISTINCT pipeline, 'key' || call_id % 70 AS key FROM u WHERE call_id % 7 = 0) GROUP BY pipeline)
SELECT s.*, round_even(1000 * correct / (tokens_in + tokens_out), 3) AS correct_per_1k, coalesce(missed, '') AS missed FROM s LEFT JOIN k USING (pipeline)""",
    "score_fields": f"""WITH {_INV} SELECT pack_id, invoice_number AS field_key, bool_or(abs(got - amount) < 0.01) AS correct FROM inv GROUP BY ALL
UNION ALL SELECT pack_id, 'no_superseded', NOT bool_or(pack_id % 4 = 0 AND invoice_number LIKE 'INV-2-%') FROM inv GROUP BY pack_id""",
    "current_invoice_totals": f"""WITH {_INV}, c AS (SELECT pack_id, invoice_number, min(amount) AS amount FROM inv WHERE NOT (pack_id % 4 = 0 AND invoice_number LIKE 'INV-2-%') GROUP BY ALL)
SELECT pack_id, count(*) AS n_invoices, round(sum(amount::DECIMAL(18, 2))::DOUBLE, 2) AS total, round(sum(amount::DECIMAL(18, 2))::DOUBLE, 2) > any_value(o_totalprice)::DOUBLE AS exceeds FROM c JOIN orders ON o_orderkey = pack_id GROUP BY pack_id""",
    "fact_checks": f"""WITH b AS (SELECT item_id, {S.sentences('text')} AS ss FROM benchmark),
c AS (SELECT doc_id, item_id, len(list_filter(ss, lambda s: contains(d.text, s)))::BIGINT AS found, len(ss)::BIGINT AS needed, length(d.text) < 20000 AS within FROM documents d, b)
SELECT doc_id, item_id, found, needed, round(found / needed, 6) AS facts_present, found = needed AND within AS answerable FROM c WHERE found > 0""",
    "answer_check": rf"""WITH a AS (SELECT item_id AS qid, {S.sentences('text')} AS ss, CASE WHEN item_id % 3 = 0 THEN ({S.sentences('text')})[1] ELSE lower(text) END AS answer FROM benchmark)
SELECT qid, coalesce(len(list_filter(ss, lambda s: NOT contains(regexp_replace(lower(answer), '[\s,]+', '', 'g'), regexp_replace(lower(s), '[\s,]+', '', 'g')))) = 0, false) AS "right" FROM a""",
}
