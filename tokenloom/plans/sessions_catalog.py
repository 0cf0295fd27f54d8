"""Queries of notes, history, sessions and context assembly over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import summary_sentences
from ..operators import history as H
from ..operators import sessions as Z
from . import sqltext as S
from .pages_catalog import CHUNKS, INDEX, chunks, head_chunks, read

PLAN = Z.Plan(window=1200, reserve=200, margin=0.05, memory=100, documents=200, trigger=0.75, keep_messages=2, keep_tools=1, summary=120)
#: The instructions of every request.
SYSTEM = (
    "You are the assistant of a long session. Answer the current request from the notes, documents and messages given here, and from nothing else. "
    "Quote names, numbers and dates as they stand. Be very brief."
)
SYSTEM_TOKENS = 60


def messages(spark, sf_dir):
    tool = (F.col("role") == "assistant") & (F.col("turn") % 3 != 0)
    return read(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(tool, F.concat(F.lit("call-"), F.col("turn").cast("string"))).alias("tool_call"),
    )


def requests(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", F.col("turn").alias("request_id"), F.col("turn").alias("as_of"), F.lit(False).alias("inclusive"), F.coalesce("text", F.lit("")).alias("query")
    )


def notes(spark, sf_dir):
    """Every sentence of an assistant message is a note."""
    told = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(summary_sentences(F.coalesce("text", F.lit("")))).alias("i", "text"))
    return told.select("conv_id", (F.col("turn") * 1000 + F.col("i")).alias("note_seq"), "turn", "text")


def select_notes(spark, sf_dir):
    return H.select_notes(requests(spark, sf_dir), notes(spark, sf_dir), PLAN.memory)


def clear_tool_results(spark, sf_dir):
    return H.clear_tool_results(messages(spark, sf_dir), 1).select("conv_id", "seq", "role", "content", "cleared")


def fifo_fit(spark, sf_dir):
    return H.fifo_fit(messages(spark, sf_dir), 600).select("conv_id", "seq", "tokens", "rest")


def extractive_summary(spark, sf_dir):
    return H.extractive_summary(messages(spark, sf_dir), PLAN.summary)


def compact_sessions(spark, sf_dir):
    return Z.compact_sessions(messages(spark, sf_dir), requests(spark, sf_dir), PLAN)


def request_history(spark, sf_dir):
    return Z.request_history(messages(spark, sf_dir), requests(spark, sf_dir))


def _turn_end(spark, sf_dir):
    """Requests of every third turn as they stand at its end: what the turn itself said is seen too."""
    return requests(spark, sf_dir).where("request_id % 3 = 0").withColumn("inclusive", F.lit(True))


def turn_end_history(spark, sf_dir):
    return Z.request_history(messages(spark, sf_dir), _turn_end(spark, sf_dir))


def turn_end_notes(spark, sf_dir):
    return H.select_notes(_turn_end(spark, sf_dir), notes(spark, sf_dir), PLAN.memory)


def turn_end_truncated(spark, sf_dir):
    return Z.assemble_truncated(messages(spark, sf_dir), _turn_end(spark, sf_dir), _kb_head(spark, sf_dir), PLAN, SYSTEM_TOKENS)


def _kb(spark, sf_dir):
    return chunks(spark, sf_dir)


def _kb_head(spark, sf_dir):
    """What a truncated context can be prefilled with."""
    return head_chunks(spark, sf_dir, int(PLAN.budget * PLAN.kb_share))


def allocate_slots(spark, sf_dir):
    noted = select_notes(spark, sf_dir).select("conv_id", "request_id", Z.token_count(F.col("memory")).alias("memory_tokens"))
    asked = requests(spark, sf_dir).join(noted, ["conv_id", "request_id"]).withColumn("document_tokens", F.lit(150))
    return Z.allocate_slots(asked, PLAN, SYSTEM_TOKENS)


def assemble_unbounded(spark, sf_dir):
    return Z.assemble_unbounded(messages(spark, sf_dir), requests(spark, sf_dir), _kb(spark, sf_dir), SYSTEM_TOKENS)


def assemble_truncated(spark, sf_dir):
    return Z.assemble_truncated(messages(spark, sf_dir), requests(spark, sf_dir), _kb_head(spark, sf_dir), PLAN, SYSTEM_TOKENS)


def engineered(spark, sf_dir):
    return Z.assemble_engineered(messages(spark, sf_dir), requests(spark, sf_dir), notes(spark, sf_dir), _kb(spark, sf_dir), PLAN, SYSTEM_TOKENS)


def assemble_engineered(spark, sf_dir):
    return engineered(spark, sf_dir)


def slot_breakdown(spark, sf_dir):
    return Z.slot_breakdown(assemble_truncated(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (select_notes, clear_tool_results, fifo_fit, extractive_summary, compact_sessions, request_history, turn_end_history, turn_end_notes, turn_end_truncated, allocate_slots, assemble_unbounded, assemble_truncated, assemble_engineered, slot_breakdown)
}

_M, _R, _N = f"m AS MATERIALIZED ({S.MESSAGES})", f"r AS MATERIALIZED ({S.REQUESTS})", f"n AS ({S.NOTES})"
_RENDERED = f"mt AS MATERIALIZED (SELECT *, {S.tokens(S.render('role', 'content', 'tool_call'))} AS tokens FROM m)"
_LINE = "'- (turn ' || turn || ') ' || text"
_TAGS = 9
_SELECTED = f"""lined AS (SELECT *, {_LINE} AS line, {S.tokens(_LINE)} + 1 AS cost, list_distinct({S.terms('text')}) AS nt FROM n),
asked AS (SELECT *, list_distinct({S.terms('query')}) AS qt FROM r),
cand AS (SELECT a.conv_id, a.request_id, l.turn, l.line, l.cost, row_number() OVER (PARTITION BY a.conv_id, a.request_id ORDER BY len(list_intersect(qt, nt)) DESC, l.turn DESC, note_seq) AS k
  FROM asked a JOIN lined l ON a.conv_id = l.conv_id AND l.turn < a.as_of WHERE cost + {_TAGS} <= {PLAN.memory}),
steps AS (SELECT conv_id, request_id, k, turn, line, {_TAGS} + cost AS used, true AS took FROM cand WHERE k = 1
  UNION ALL SELECT c.conv_id, c.request_id, c.k, c.turn, c.line, CASE WHEN s.used + c.cost <= {PLAN.memory} THEN s.used + c.cost ELSE s.used END, s.used + c.cost <= {PLAN.memory}
  FROM steps s JOIN cand c ON c.conv_id = s.conv_id AND c.request_id = s.request_id AND c.k = s.k + 1),
chosen AS (SELECT conv_id, request_id, count(*) AS n_notes, '<memory>' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) || chr(10) || '</memory>' AS memory FROM steps WHERE took GROUP BY ALL),
noted AS (SELECT r.conv_id, r.request_id, coalesce(n_notes, 0) AS n_notes, coalesce(memory, '') AS memory FROM r LEFT JOIN chosen USING (conv_id, request_id))"""
_SEEN = """seen AS (SELECT r.conv_id, r.request_id, any_value(query) AS query, count(mt.seq) AS n_messages, coalesce(sum(mt.tokens), 0)::BIGINT AS history_tokens
  FROM r LEFT JOIN mt ON mt.conv_id = r.conv_id AND mt.turn < r.as_of GROUP BY r.conv_id, r.request_id)"""
_Q = S.tokens("'<current_request>' || chr(10) || query || chr(10) || '</current_request>'")
_CHUNK = S.tokens("""'<document id="' || chunk_id || '" title="' || title || '">' || chr(10) || text || chr(10) || '</document>'""")
_TAG = Z.TAG_TOKENS["conversation"]


def _slots(name: str, documents: str, history: str, source: str, extra: str = "") -> str:
    return f"""SELECT conv_id, request_id, '{name}' AS strategy, {SYSTEM_TOKENS}::BIGINT AS slot_system, 0::BIGINT AS slot_memory, ({documents})::BIGINT AS slot_documents, ({history})::BIGINT AS slot_history, {_Q} AS slot_query,
  ({SYSTEM_TOKENS} + {documents} + {history} + {_Q})::BIGINT AS tokens, 0::BIGINT AS compactions FROM {source}{extra}"""


_TRUNCATED = f"""WITH RECURSIVE {CHUNKS}, {_M}, {_R}, {_RENDERED}, {_SEEN},
pre AS (SELECT coalesce(sum(t), 0) AS documents FROM (SELECT {_CHUNK} AS t, sum(tokens + 12) OVER (ORDER BY doc_id, chunk_no) AS running FROM chunks) WHERE running <= {int(PLAN.budget * PLAN.kb_share)}),
roomy AS (SELECT seen.*, documents, {PLAN.budget - SYSTEM_TOKENS - 40} - documents - {_Q} AS room FROM seen, pre),
tails AS (SELECT r.conv_id, r.request_id, sum(mt.tokens) OVER (PARTITION BY r.conv_id, r.request_id ORDER BY mt.seq DESC) AS tail, room FROM roomy r JOIN mt ON mt.conv_id = r.conv_id AND mt.turn < r.request_id),
fit AS (SELECT conv_id, request_id, max(tail) AS kept FROM tails WHERE tail <= room GROUP BY ALL),
joined AS (SELECT roomy.*, coalesce(kept, 0) AS kept FROM roomy LEFT JOIN fit USING (conv_id, request_id))
{_slots('truncated', 'documents', f'kept + CASE WHEN kept > 0 THEN {_TAG} ELSE 0 END', 'joined')}"""

_STUB = f"""'[cleared ' || {S.tokens('content')} || '-token result of ' || coalesce(tool_call, 'None') || '; key findings are in the assistant reply that followed. Re-run the tool if raw output is needed.]'"""
_SENT = f"struct_pack(text := s, score := {S.salience('role', 's')}, again := {S.salience(chr(39) + 'summary' + chr(39), 's')}, cost := {S.tokens('s')} + 2)"
_KEPT = "STRUCT(ord BIGINT, text VARCHAR, again DOUBLE, cost BIGINT)[]"
_PICK = "STRUCT(less DOUBLE, ord BIGINT, text VARCHAR, again DOUBLE, cost BIGINT)[]"


def replay_sql(asked: str) -> str:
    """sent(conv_id, request_id, strategy, history_tokens, first_seq, n_messages, summary, compactions) of ``asked(conv_id, request_id, as_of, inclusive, strategy, remaining,
    clearing, compaction)``: sessions are replayed a request at a time by recursion, from lists of each session's messages."""
    told = "coalesce(list_sum(list_transform(summary, lambda s: s.cost - 1)), 0)"
    return f"""mc AS MATERIALIZED (SELECT conv_id, seq, turn, role, raw, cut, {S.tokens('raw')} AS tok, {S.tokens('cut')} AS stub, cleared, sents, count(*) FILTER (role = 'tool') OVER (PARTITION BY conv_id ORDER BY seq) AS nth FROM (
  SELECT *, {S.render('role', 'content', 'tool_call')} AS raw, {S.render('role', f'({_STUB})', 'tool_call')} AS cut, starts_with(content, '[cleared') AS cleared,
    list_transform({S.sentences('content')}, lambda s: {_SENT}) AS sents FROM m)),
ml AS MATERIALIZED (SELECT conv_id, list(struct_pack(turn := turn, tool := role = 'tool', nth := nth, tok := tok, stub := stub, cleared := cleared, sents := sents, raw := raw, cut := cut) ORDER BY seq) AS ms FROM mc GROUP BY conv_id),
seen AS (SELECT a.*, ms, len(list_filter(ms, lambda x: x.turn < as_of OR inclusive AND x.turn = as_of)) AS vis FROM {asked} a JOIN ml USING (conv_id) WHERE as_of IS NOT NULL),
viewed AS MATERIALIZED (SELECT *, remaining - {Z.WRAP} AS hb, list_transform(ms[1:vis], lambda x: CASE WHEN clearing AND x.tool AND x.nth <= coalesce(ms[vis].nth, 0) - {PLAN.keep_tools} THEN x.stub ELSE x.tok END) AS ta,
  row_number() OVER (PARTITION BY conv_id, strategy ORDER BY request_id) AS k FROM seen),
st(conv_id, strategy, k, summary, upto, comps) AS (
  SELECT DISTINCT conv_id, strategy, 0::BIGINT, []::{_KEPT}, 0::BIGINT, 0::BIGINT FROM viewed
  UNION ALL
  SELECT conv_id, strategy, k, CASE WHEN go THEN list_sort(list_transform(list_reduce(list_concat([struct_pack(used := 0::BIGINT, said := []::VARCHAR[], picks := []::{_PICK})],
      list_transform(list_sort(list_transform(list_concat(list_transform(summary, lambda s: struct_pack(text := s.text, score := s.again, again := s.again, cost := s.cost)),
        flatten(list_transform(list_filter(ms[upto + 1:vis - {PLAN.keep_messages}], lambda x: NOT x.cleared), lambda x: x.sents))), lambda s, i: struct_pack(less := -s.score, ord := i::BIGINT, text := s.text, again := s.again, cost := s.cost))),
        lambda p: struct_pack(used := 0::BIGINT, said := []::VARCHAR[], picks := [p]))),
      lambda acc, e: CASE WHEN list_contains(acc.said, lower(e.picks[1].text)) OR acc.used + e.picks[1].cost > {PLAN.summary} THEN acc
        ELSE struct_pack(used := acc.used + e.picks[1].cost, said := list_append(acc.said, lower(e.picks[1].text)), picks := list_concat(acc.picks, e.picks)) END).picks,
      lambda p: struct_pack(ord := p.ord, text := p.text, again := p.again, cost := p.cost))) ELSE summary END,
    CASE WHEN go THEN vis - {PLAN.keep_messages} ELSE upto END, comps + go::BIGINT
  FROM (SELECT v.conv_id, v.strategy, v.k, summary, upto, comps, vis, ms,
      compaction AND coalesce(list_sum(ta[upto + 1:]), 0) + {told} > hb * {PLAN.trigger}::DOUBLE AND vis - upto > {PLAN.keep_messages} AS go
    FROM st JOIN viewed v ON v.conv_id = st.conv_id AND v.strategy = st.strategy AND v.k = st.k + 1)),
h0 AS (SELECT v.conv_id, request_id, v.strategy, remaining, vis, ta, ms, clearing, hb, comps, CASE WHEN compaction THEN summary ELSE [] END AS summary, CASE WHEN compaction THEN upto ELSE 0 END AS base
  FROM viewed v JOIN st ON st.conv_id = v.conv_id AND st.strategy = v.strategy AND st.k = v.k),
h1 AS (SELECT *, len(list_filter(range(1, vis - base + 1), lambda j: coalesce(list_sum(ta[vis - j + 1:]), 0) <= hb - {told} - CASE WHEN len(summary) > 0 THEN {Z.SUMMARY_WRAP} ELSE 0 END)) AS fit FROM h0),
h2 AS (SELECT *, CASE WHEN vis > base THEN vis - fit ELSE vis END AS first_seq FROM h1),
h3 AS (SELECT *, CASE WHEN first_seq < vis THEN coalesce(list_sum(ta[first_seq + 1:]), 0) + {Z.TAG_TOKENS['conversation']} ELSE 0 END AS msgs,
  list_transform(range(0, len(summary) + 1), lambda d: CASE WHEN d < len(summary) THEN list_sum(list_transform(summary[d + 1:], lambda s: s.cost - 1)) + {Z.TAG_TOKENS['summary']} ELSE 0 END) AS tolds FROM h2),
h4 AS (SELECT *, coalesce(list_filter(range(0, len(summary) + 1), lambda d: tolds[d + 1] + msgs <= remaining)[1], len(summary)) AS d FROM h3),
sent AS MATERIALIZED (SELECT conv_id, request_id, strategy, (tolds[d + 1] + msgs)::BIGINT AS history_tokens, first_seq::BIGINT AS first_seq, (vis - first_seq)::BIGINT AS n_messages,
  coalesce(array_to_string(list_transform(summary[d + 1:], lambda s: '- ' || s.text), chr(10)), '') AS summary, comps AS compactions, ms[first_seq + 1:vis] AS shown, coalesce(ms[vis].nth, 0) AS tools, clearing FROM h4
  UNION ALL SELECT conv_id, request_id, strategy, 0, 0, 0, '', 0, [], 0, clearing FROM {asked} WHERE as_of IS NULL)"""

RENDER = """'<document id="' || chunk_id || '" title="' || title || '">' || chr(10) || text || chr(10) || '</document>'"""
_KINDS = ", ".join(
    f"('{k}', {v.get('retrieval', True)}, {v.get('clearing', True)}, {v.get('compaction', True)}, {v.get('memory', True)})" for k, v in Z.ABLATIONS.items()
)


def engineered_sql(system_tokens: int) -> str:
    """built(conv_id, request_id, strategy, slots, what is shown) of the requests ``r`` over notes ``n``, messages ``m`` and the index of chunks."""
    share = int(PLAN.budget * PLAN.kb_share)
    return f"""rq AS MATERIALIZED (SELECT *, {_Q} AS slot_query, {PLAN.budget} - {system_tokens} - {_Q} AS room FROM r),
lined AS MATERIALIZED (SELECT *, {_LINE} AS line, {S.tokens(_LINE)} + 1 AS cost, list_distinct({S.terms('text')}) AS nt FROM n),
note_asked AS (SELECT *, list_distinct({S.terms('query')}) AS qt, greatest(0, least({PLAN.memory}, room)) AS allowed FROM rq),
cand AS MATERIALIZED (SELECT a.conv_id, a.request_id, allowed, l.turn, l.line, l.cost, row_number() OVER (PARTITION BY a.conv_id, a.request_id ORDER BY len(list_intersect(qt, nt)) DESC, l.turn DESC, note_seq) AS k
  FROM note_asked a JOIN lined l ON a.conv_id = l.conv_id AND (as_of IS NULL OR l.turn < a.as_of OR inclusive AND l.turn = as_of) WHERE cost + {_TAGS} <= allowed),
note_steps AS (SELECT conv_id, request_id, k, turn, line, {_TAGS} + cost AS used, true AS took FROM cand WHERE k = 1
  UNION ALL SELECT c.conv_id, c.request_id, c.k, c.turn, c.line, CASE WHEN s.used + c.cost <= allowed THEN s.used + c.cost ELSE s.used END, s.used + c.cost <= allowed
  FROM note_steps s JOIN cand c ON c.conv_id = s.conv_id AND c.request_id = s.request_id AND c.k = s.k + 1),
chosen AS (SELECT conv_id, request_id, '<memory>' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) || chr(10) || '</memory>' AS memory FROM note_steps WHERE took GROUP BY ALL),
noted AS MATERIALIZED (SELECT rq.*, coalesce(memory, '') AS memory, {S.tokens("coalesce(memory, '')")} AS memory_tokens FROM rq LEFT JOIN chosen USING (conv_id, request_id)),
grants AS MATERIALIZED (SELECT *, greatest(0, least({PLAN.documents}, rest)) AS allowed FROM (SELECT noted.*, noting, room - CASE WHEN noting THEN memory_tokens ELSE 0 END AS rest FROM noted, (VALUES (true), (false)) v(noting))),
qt AS (SELECT conv_id, request_id, term, count(*) AS qtf FROM (SELECT conv_id, request_id, unnest({S.terms('query')}) AS term FROM rq) GROUP BY ALL),
scored AS MATERIALIZED (SELECT conv_id, request_id, doc_id, chunk_no, round(sum(qtf * idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM qt JOIN postings USING (term) JOIN idf USING (term), stats GROUP BY ALL HAVING score > 0),
near AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY conv_id, request_id) AS top FROM scored) WHERE top >= 2 AND score >= round(top * 0.6, 6)),
sized AS MATERIALIZED (SELECT g.conv_id, g.request_id, noting, allowed, doc_id, chunk_no, tokens, {S.tokens(RENDER)} AS t, {RENDER} AS body, row_number() OVER (PARTITION BY g.conv_id, g.request_id, noting ORDER BY score DESC, doc_id, chunk_no) AS k
  FROM grants g JOIN near USING (conv_id, request_id) JOIN chunks USING (doc_id, chunk_no) WHERE tokens + 12 <= allowed),
pick_steps AS (SELECT conv_id, request_id, noting, k, t, body, tokens + 12 AS used, 1 AS got, true AS took FROM sized WHERE k = 1
  UNION ALL SELECT z.conv_id, z.request_id, z.noting, z.k, z.t, z.body, CASE WHEN s.got < 4 AND s.used + z.tokens + 12 <= allowed THEN s.used + z.tokens + 12 ELSE s.used END,
  CASE WHEN s.got < 4 AND s.used + z.tokens + 12 <= allowed THEN s.got + 1 ELSE s.got END, s.got < 4 AND s.used + z.tokens + 12 <= allowed
  FROM pick_steps s JOIN sized z ON z.conv_id = s.conv_id AND z.request_id = s.request_id AND z.noting = s.noting AND z.k = s.k + 1),
picked AS (SELECT conv_id, request_id, noting, sum(t)::BIGINT AS t, string_agg(body, chr(10) ORDER BY k) AS body FROM pick_steps WHERE took GROUP BY ALL),
heads AS MATERIALIZED (SELECT * FROM (SELECT doc_id, chunk_no, {S.tokens(RENDER)} AS t, {RENDER} AS body, sum(tokens + 12) OVER (ORDER BY doc_id, chunk_no) AS running FROM chunks) WHERE running <= {share}),
prefilled AS (SELECT conv_id, request_id, noting, coalesce(sum(t), 0)::BIGINT AS t, coalesce(string_agg(body, chr(10) ORDER BY running), '') AS body
  FROM grants LEFT JOIN heads ON running <= greatest(0, least({share}, rest)) GROUP BY ALL),
kinds(strategy, retrieval, clearing, compaction, memory) AS (VALUES {_KINDS}),
rows AS MATERIALIZED (SELECT g.conv_id, g.request_id, g.as_of, g.inclusive, g.query, slot_query, k.strategy, k.clearing, k.compaction, CASE WHEN g.noting THEN memory_tokens ELSE 0 END AS slot_memory, CASE WHEN g.noting THEN g.memory ELSE '' END AS memory,
  CASE WHEN retrieval THEN coalesce(p.t, 0) ELSE f.t END AS slot_documents, CASE WHEN retrieval THEN coalesce(p.body, '') ELSE f.body END AS documents
  FROM grants g JOIN kinds k ON k.memory = g.noting LEFT JOIN picked p ON p.conv_id = g.conv_id AND p.request_id = g.request_id AND p.noting = g.noting JOIN prefilled f ON f.conv_id = g.conv_id AND f.request_id = g.request_id AND f.noting = g.noting),
engineered_asked AS MATERIALIZED (SELECT conv_id, request_id, as_of, inclusive, strategy, {PLAN.budget} - {system_tokens} - slot_query - slot_memory - slot_documents AS remaining, clearing, compaction FROM rows),
{replay_sql('engineered_asked')},
built AS MATERIALIZED (SELECT conv_id, request_id, strategy, {system_tokens}::BIGINT AS slot_system, slot_memory::BIGINT AS slot_memory, slot_documents::BIGINT AS slot_documents, history_tokens AS slot_history, slot_query,
  ({system_tokens} + slot_query + slot_memory + slot_documents + history_tokens)::BIGINT AS tokens, compactions, first_seq, n_messages, summary, {PLAN.budget} - {system_tokens} - slot_query - slot_memory - slot_documents < 0 AS overflow,
  memory, documents, shown, tools, sent.clearing, query FROM rows JOIN sent USING (conv_id, request_id, strategy))"""


def _at_turn_end(sql: str) -> str:
    """The same for requests of every third turn that see their turn's own messages and notes."""
    return sql.replace("WHERE role = 'user')", "WHERE role = 'user' AND turn % 3 = 0)", 1).replace("turn < r.as_of", "turn <= r.as_of").replace("l.turn < a.as_of", "l.turn <= a.as_of").replace("mt.turn < r.request_id", "mt.turn <= r.request_id")


ORACLE_SQL = {
    "assemble_engineered": f"""WITH RECURSIVE {INDEX}, {_M}, {_R}, {_N}, {engineered_sql(SYSTEM_TOKENS)}
SELECT conv_id, request_id, strategy, slot_system, slot_memory, slot_documents, slot_history, slot_query, tokens, compactions, first_seq, n_messages, summary, overflow FROM built""",
    "compact_sessions": f"""WITH RECURSIVE {_M}, {_R}, asked AS (SELECT conv_id, request_id, as_of, inclusive, 'compact' AS strategy, {PLAN.budget}::BIGINT AS remaining, true AS clearing, true AS compaction FROM r), {replay_sql('asked')}
SELECT conv_id, request_id, history_tokens, first_seq, n_messages, summary, compactions FROM sent""",
    "turn_end_history": _at_turn_end(f"WITH {_M}, {_R}, {_RENDERED}, {_SEEN} SELECT conv_id, request_id, n_messages, history_tokens FROM seen"),
    "turn_end_notes": _at_turn_end(f"WITH RECURSIVE {_R}, {_N}, {_SELECTED} SELECT * FROM noted"),
    "turn_end_truncated": _at_turn_end(_TRUNCATED),
    "select_notes": f"WITH RECURSIVE {_R}, {_N}, {_SELECTED} SELECT * FROM noted",
    "clear_tool_results": f"""WITH {_M}, k AS (SELECT *, role = 'tool' AND row_number() OVER (PARTITION BY conv_id, role = 'tool' ORDER BY seq DESC) > 1 AS cleared FROM m)
SELECT conv_id, seq, role, cleared, CASE WHEN cleared THEN '[cleared ' || {S.tokens('content')} || '-token result of ' || tool_call ||
  '; key findings are in the assistant reply that followed. Re-run the tool if raw output is needed.]' ELSE content END AS content FROM k""",
    "fifo_fit": f"WITH {_M}, {_RENDERED} SELECT * FROM (SELECT conv_id, seq, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq DESC)::BIGINT AS rest FROM mt) WHERE rest <= 600",
    "extractive_summary": f"""WITH RECURSIVE {_M}, s AS (SELECT conv_id, seq, role, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT conv_id, seq, role, {S.sentences('content')} AS ss FROM m WHERE NOT starts_with(content, '[cleared'))),
scored AS (SELECT conv_id, seq, i, s, {S.salience('role', 's')} AS score, {S.tokens('s')} + 2 AS cost FROM s),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(s) ORDER BY score DESC, seq, i) AS nth FROM scored) WHERE nth = 1 AND cost <= {PLAN.summary}),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, seq, i) AS k FROM once),
steps AS (SELECT conv_id, k, seq, i, s, cost AS used, true AS took FROM ordered WHERE k = 1
  UNION ALL SELECT o.conv_id, o.k, o.seq, o.i, o.s, CASE WHEN p.used + o.cost <= {PLAN.summary} THEN p.used + o.cost ELSE p.used END, p.used + o.cost <= {PLAN.summary}
  FROM steps p JOIN ordered o ON o.conv_id = p.conv_id AND o.k = p.k + 1),
chosen AS (SELECT conv_id, count(*) AS n_sentences, string_agg('- ' || s, chr(10) ORDER BY seq, i) AS summary FROM steps WHERE took GROUP BY conv_id)
SELECT c.conv_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(summary, '') AS summary FROM (SELECT DISTINCT conv_id FROM m) c LEFT JOIN chosen USING (conv_id)""",
    "request_history": f"WITH {_M}, {_R}, {_RENDERED}, {_SEEN} SELECT conv_id, request_id, n_messages, history_tokens FROM seen",
    "allocate_slots": f"""WITH RECURSIVE {_R}, {_N}, {_SELECTED}, c AS (SELECT conv_id, request_id, {_Q} AS q, {S.tokens('memory')} AS mem FROM r JOIN noted USING (conv_id, request_id)),
l AS (SELECT *, {PLAN.budget} - {SYSTEM_TOKENS} - q AS l1, {PLAN.budget} - {SYSTEM_TOKENS} - q - mem AS l2, {PLAN.budget} - {SYSTEM_TOKENS} - q - mem - 150 AS l3 FROM c)
SELECT conv_id, request_id, q AS query_tokens, greatest(0, least({PLAN.memory}, l1))::BIGINT AS granted_memory, greatest(0, least({PLAN.documents}, l2))::BIGINT AS granted_documents,
  greatest(0, l3 - 40)::BIGINT AS granted_history, l3::BIGINT AS remaining, l3 < 0 AS overflow FROM l""",
    "assemble_unbounded": f"""WITH RECURSIVE {CHUNKS}, {_M}, {_R}, {_RENDERED}, {_SEEN}, kb AS (SELECT coalesce(sum({_CHUNK}), 0) AS documents FROM chunks)
{_slots('unbounded', 'documents', f'history_tokens + CASE WHEN n_messages > 0 THEN {_TAG} ELSE 0 END', 'seen', ', kb')}""",
    "assemble_truncated": _TRUNCATED,
    "slot_breakdown": f"""SELECT conv_id, request_id, strategy, replace(slot, 'slot_', '') AS slot, tokens FROM (
  UNPIVOT (SELECT * EXCLUDE (tokens, compactions) FROM ({_TRUNCATED})) ON slot_system, slot_memory, slot_documents, slot_history, slot_query INTO NAME slot VALUE tokens)""",
}
