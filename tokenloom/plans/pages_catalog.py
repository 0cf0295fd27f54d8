"""Queries of text functions, page cleaning and retrieval over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from ..operators import retrieval as R
from . import sqltext as S

_WORD = r"(?<![\p{L}\p{N}_])(%s)(?![\p{L}\p{N}_])"
_PARTS = [("license", "licen"), ("english", "the|and|of"), ("german", "der|die|und"), ("french", "le|les|des"), ("spanish", "el|los|las")]
RULES = [(k, p if k == "license" else _WORD % p) for k, p in _PARTS]
ROUTES = {"western": ["english", "license"], "central": ["german", "french"], "any": ["english", "german", "spanish"]}
LANG_RATIO, SOURCE_RATIO, SEP = 0.03, 0.1, "\n"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def packs(spark, sf_dir, by="lang"):
    return P.load_pages(docs(spark, sf_dir), by, "doc_id", "text")


def token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n_terms"), F.array_join(T.terms(F.col("text")), " ").alias("terms"))


def sentences(spark, sf_dir):
    found = T.summary_sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.array_join(found, "|").alias("sentences"))


def sentence_salience(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(T.summary_sentences(F.col("text"))).alias("i", "s"))
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.round(T.salience(F.col("role"), F.col("s")), 6).alias("score"))


def repeated_lines(spark, sf_dir):
    return P.repeated_lines(packs(spark, sf_dir, "source"), SOURCE_RATIO)


def clean_pages(spark, sf_dir):
    return P.clean_pages(packs(spark, sf_dir), LANG_RATIO)


def duplicate_pages(spark, sf_dir):
    return P.drop_duplicate_pages(packs(spark, sf_dir)).select("pack_id", "page_no", "dropped_reason")


def classify_pages(spark, sf_dir):
    return P.classify_pages(packs(spark, sf_dir), RULES).select("pack_id", "page_no", "kind")


def _boiler(spark, sf_dir):
    kind = F.when(F.col("page_no") % 5 == 0, "terms").otherwise("other")
    return packs(spark, sf_dir).withColumn("kind", kind).withColumn("dropped_reason", F.lit(None).cast("string"))


def strip_boilerplate(spark, sf_dir):
    return P.strip_boilerplate(_boiler(spark, sf_dir)).select("pack_id", "page_no", "text", F.size("notes").cast("long").alias("n_notes"))


def _classified(spark, sf_dir):
    return P.classify_pages(P.drop_duplicate_pages(P.clean_pages(packs(spark, sf_dir), LANG_RATIO)), RULES)


def route_pages(spark, sf_dir):
    return P.route_pages(_classified(spark, sf_dir), ROUTES).select("pack_id", "page_no", "task", "kind")


def prepare_packs(spark, sf_dir):
    return P.prepare(packs(spark, sf_dir), LANG_RATIO, RULES, ("license",)).select("pack_id", "page_no", "kind", "dropped_reason", "text")


def tokens_by_kind(spark, sf_dir):
    return P.tokens_by_kind(packs(spark, sf_dir), _classified(spark, sf_dir), ROUTES, ("pack_id",))


def chunks(spark, sf_dir):
    return R.chunk_documents(docs(spark, sf_dir), sep=SEP, title="source")


def head_chunks(spark, sf_dir, budget):
    """The chunks that a prefill from ``budget`` looks at, and some more."""
    return R.chunk_documents(R.head_documents(docs(spark, sf_dir), budget, SEP), sep=SEP, title="source")


def chunk_documents(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id", "title", "text", "tokens")


def bm25_index(spark, sf_dir):
    postings, idf, _ = R.bm25_index(chunks(spark, sf_dir))
    weighed = postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.sum("dl").alias("dl_sum"))
    return idf.join(weighed, "term").select("term", "df", F.round("idf", 6).alias("idf"), "cf", "max_tf", "dl_sum")


def queries(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_search(spark, sf_dir):
    return R.bm25_search(queries(spark, sf_dir), chunks(spark, sf_dir)).select("query_id", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "score", "rank")


def bm25_near(spark, sf_dir):
    return R.bm25_near(queries(spark, sf_dir), chunks(spark, sf_dir)).select("query_id", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "score", "rank")


def pack_chunks(spark, sf_dir):
    found = R.bm25_near(queries(spark, sf_dir), chunks(spark, sf_dir))
    return R.pack_chunks(found, chunks(spark, sf_dir), 1000).select("query_id", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "score", "tokens", "pick")


def prefill_documents(spark, sf_dir):
    return R.prefill_documents(head_chunks(spark, sf_dir, 20_000), 20_000).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "tokens", "running")


QUERIES = {
    f.__name__: f
    for f in (
        token_count, terms, sentences, sentence_salience, repeated_lines, clean_pages, duplicate_pages, classify_pages, strip_boilerplate, route_pages, prepare_packs,
        tokens_by_kind, chunk_documents, bm25_index, bm25_search, bm25_near, pack_chunks, prefill_documents,
    )
}


def _repeated(by: str, ratio: float) -> str:
    return f"""pages AS (SELECT {by} AS pack_id, doc_id AS page_no, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
shapes AS (SELECT pack_id, page_no, unnest(list_distinct(list_transform(list_filter(ls, lambda x: trim(x) <> ''), lambda x: {S.shape('x')}))) AS shape FROM pages),
totals AS (SELECT pack_id, count(*) AS pack_pages FROM pages GROUP BY ALL),
repeated AS (SELECT pack_id, shape, count(*) AS n_pages, any_value(pack_pages) AS pack_pages FROM shapes JOIN totals USING (pack_id) GROUP BY pack_id, shape HAVING count(*) >= any_value(pack_pages) * {ratio})"""


_CLEAN = _repeated("lang", LANG_RATIO) + rf""",
lists AS (SELECT pack_id, list(shape) AS rep FROM repeated GROUP BY ALL),
cleaned AS (SELECT pack_id, page_no, array_to_string(list_transform(list_filter(ls, lambda x: NOT list_contains(coalesce(rep, []), {S.shape('x')})
  AND NOT regexp_matches(x, '(?i)^\s*page \p{{Nd}}+ of \p{{Nd}}+\s*$') AND NOT starts_with(trim(x), '>') AND trim(x) <> ''),
  lambda x: regexp_replace(regexp_replace(x, '\s+$', ''), '[ \t]{{2,}}', '  ', 'g')), chr(10)) AS text FROM pages LEFT JOIN lists USING (pack_id))"""


def _duplicates(source: str) -> str:
    return f"""keyed AS (SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(lower(x), 'duplicate')), chr(10)) AS k FROM {source}),
firsts AS (SELECT *, min(page_no) OVER (PARTITION BY pack_id, k) AS first FROM keyed),
deduped AS (SELECT pack_id, page_no, text, CASE WHEN page_no > first THEN 'duplicate of page ' || first END AS dropped_reason FROM firsts)"""


def _kind(text: str) -> str:
    head = f"lower(array_to_string(string_split({text}, chr(10))[1:3], chr(10)))"
    tests = [f"WHEN regexp_matches({head}, '" + (p if k == "license" else rf"(?:^|[^\p{{L}}\p{{N}}_])({p})(?:$|[^\p{{L}}\p{{N}}_])") + f"') THEN '{k}'" for k, p in _PARTS]
    return f"CASE {' '.join(tests)} ELSE 'unknown' END"


_ROUTES = "routes(task, kind) AS (VALUES " + ", ".join(f"('{t}', '{k}')" for t, ks in ROUTES.items() for k in ks) + ")"
_CLASSIFIED = f"{_CLEAN}, {_duplicates('cleaned')}, classified AS (SELECT *, {_kind('text')} AS kind FROM deduped)"
CHUNKS = f"""paras AS (SELECT doc_id, source AS title, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS para FROM
  (SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents)),
counted AS MATERIALIZED (SELECT *, {S.tokens('para')} AS t FROM paras),
walked AS (SELECT doc_id, i, 0 AS chunk_no, t AS used FROM counted WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN w.used + c.t > 350 THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.used + c.t > 350 THEN c.t ELSE w.used + c.t END
  FROM walked w JOIN counted c ON c.doc_id = w.doc_id AND c.i = w.i + 1),
chunks AS MATERIALIZED (SELECT doc_id, chunk_no, doc_id || '#' || chunk_no AS chunk_id, any_value(title) AS title, string_agg(para, chr(10) ORDER BY i) AS text, sum(t)::BIGINT AS tokens
  FROM counted JOIN walked USING (doc_id, i) GROUP BY doc_id, chunk_no)"""
INDEX = f"""{CHUNKS}, ct AS (SELECT doc_id, chunk_no, {S.terms("title || ' ' || text")} AS ts FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avg_dl FROM ct),
postings AS MATERIALIZED (SELECT term, doc_id, chunk_no, dl, count(*) AS tf FROM (SELECT doc_id, chunk_no, len(ts) AS dl, unnest(ts) AS term FROM ct) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY term)"""
_SEARCH = f"""{INDEX}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({S.terms('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, chunk_no, round(sum(qtf * idf * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM qt JOIN postings USING (term) JOIN idf USING (term), stats GROUP BY ALL HAVING score > 0),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM scored)"""



def _stripped(source: str, kinds: tuple[str, ...], least: int = 40) -> str:
    """stripped(pack_id, page_no, kind, dropped_reason, text, n_notes) of ``source(pack_id, page_no, kind, dropped_reason, text)``.

    Expressions have no look-behind here, so numbers that follow each other are taken away in several passes."""
    boiler = "kind IN (" + ", ".join(f"'{k}'" for k in kinds) + ")"
    flat = "regexp_replace(text, '\\s+', ' ', 'g') || CASE WHEN page_no = last_no THEN '' ELSE ' ' END"
    for _ in range(3):
        flat = rf"regexp_replace({flat}, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}+\.\s', '\1', 'g')"
    return rf"""ends AS (SELECT *, max(page_no) OVER (PARTITION BY pack_id) AS last_no FROM {source} WHERE {boiler}),
wholes AS (SELECT pack_id, string_agg({flat}, '' ORDER BY page_no) AS whole FROM ends GROUP BY pack_id),
said AS (SELECT DISTINCT pack_id, trim(unnest(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM wholes),
told AS MATERIALIZED (SELECT pack_id, list(s ORDER BY -length(s), encode(s)) AS ss FROM said WHERE length(s) > {least} GROUP BY pack_id),
live AS (SELECT t.*, regexp_replace(text, '\s+', ' ', 'g') AS flat, ss FROM {source} t LEFT JOIN told USING (pack_id) WHERE NOT ({boiler}) AND dropped_reason IS NULL),
cut AS (SELECT pack_id, page_no, text, list_reduce(list_concat([text], list_transform(list_filter(coalesce(ss, []), lambda s: contains(flat, s)),
  lambda s: replace(regexp_escape(s), '\ ', '\s+'))), lambda t, p: regexp_replace(t, p, '', 'g')) AS rest FROM live),
lined AS (SELECT pack_id, page_no, text, list_filter(string_split(rest, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(\p{{Nd}}+\.)?\s*$')) AS kept FROM cut),
shown AS (SELECT pack_id, page_no, array_to_string(list_transform(kept, lambda x: regexp_replace(x, '\s+$', '')), chr(10)) AS text,
  (len(kept) <> CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS n_notes FROM lined),
stripped AS (SELECT t.pack_id, t.page_no, kind, dropped_reason, CASE WHEN s.page_no IS NULL THEN t.text ELSE s.text END AS text, coalesce(n_notes, 0) AS n_notes
  FROM {source} t LEFT JOIN shown s USING (pack_id, page_no))"""


ORACLE_SQL = {
    "strip_boilerplate": f"""WITH boiler AS (SELECT lang AS pack_id, doc_id AS page_no, CASE WHEN doc_id % 5 = 0 THEN 'terms' ELSE 'other' END AS kind, NULL AS dropped_reason, coalesce(text, '') AS text FROM documents),
{_stripped('boiler', P.BOILERPLATE_KINDS)} SELECT pack_id, page_no, text, n_notes FROM stripped""",
    "prepare_packs": f"WITH {_CLASSIFIED}, {_stripped('classified', ('license',))} SELECT pack_id, page_no, kind, dropped_reason, text FROM stripped",
    "token_count": f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents",
    "terms": f"SELECT doc_id, len(ts)::BIGINT AS n_terms, array_to_string(ts, ' ') AS terms FROM (SELECT doc_id, {S.terms('text')} AS ts FROM documents)",
    "sentences": f"SELECT doc_id, len(ss)::BIGINT AS n_sentences, array_to_string(ss, '|') AS sentences FROM (SELECT doc_id, {S.sentences('text')} AS ss FROM documents)",
    "sentence_salience": f"""SELECT conv_id, turn, i::BIGINT AS i, round({S.salience('role', 's')}, 6) AS score FROM
  (SELECT conv_id, turn, role, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT conv_id, turn, role, {S.sentences('text')} AS ss FROM conversations))""",
    "repeated_lines": f"WITH {_repeated('source', SOURCE_RATIO)} SELECT * FROM repeated",
    "clean_pages": f"WITH {_CLEAN} SELECT * FROM cleaned",
    "duplicate_pages": f"WITH p AS (SELECT lang AS pack_id, doc_id AS page_no, coalesce(text, '') AS text FROM documents), {_duplicates('p')} SELECT pack_id, page_no, dropped_reason FROM deduped",
    "classify_pages": f"SELECT lang AS pack_id, doc_id AS page_no, {_kind('text')} AS kind FROM documents",
    "route_pages": f"WITH {_CLASSIFIED}, {_ROUTES} SELECT pack_id, page_no, task, kind FROM classified JOIN routes USING (kind) WHERE dropped_reason IS NULL",
    "tokens_by_kind": f"""WITH {_CLASSIFIED}, {_ROUTES}, routed AS (SELECT DISTINCT pack_id, page_no FROM classified JOIN routes USING (kind) WHERE dropped_reason IS NULL)
SELECT c.pack_id, kind, count(*) AS pages, sum({S.tokens('p.text')})::BIGINT AS raw_tokens, sum(CASE WHEN r.page_no IS NOT NULL THEN {S.tokens('c.text')} ELSE 0 END)::BIGINT AS sent_tokens
FROM classified c JOIN pages p USING (pack_id, page_no) LEFT JOIN routed r USING (pack_id, page_no) GROUP BY c.pack_id, kind""",
    "chunk_documents": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no::BIGINT AS chunk_no, chunk_id, title, text, tokens FROM chunks",
    "bm25_index": f"""WITH RECURSIVE {INDEX} SELECT term, df, round(any_value(idf), 6) AS idf, sum(tf)::BIGINT AS cf, max(tf) AS max_tf, sum(dl)::BIGINT AS dl_sum
FROM postings JOIN idf USING (term) GROUP BY term, df""",
    "bm25_search": f"WITH RECURSIVE {_SEARCH} SELECT query_id, doc_id, chunk_no::BIGINT AS chunk_no, score, rank FROM ranked",
    "bm25_near": f"""WITH RECURSIVE {_SEARCH}, topped AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ranked)
SELECT query_id, doc_id, chunk_no::BIGINT AS chunk_no, score, rank FROM topped WHERE top >= 2 AND score >= round(top * 0.6, 6)""",
    "pack_chunks": f"""WITH RECURSIVE {_SEARCH},
near AS MATERIALIZED (SELECT r.*, c.tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM
  (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ranked) r JOIN chunks c USING (doc_id, chunk_no) WHERE top >= 2 AND score >= round(top * 0.6, 6) AND tokens + 12 <= 1000),
steps AS (SELECT query_id, k, doc_id, chunk_no, score, tokens, tokens + 12 AS used, 1 AS n, true AS took FROM near WHERE k = 1
  UNION ALL SELECT n.query_id, n.k, n.doc_id, n.chunk_no, n.score, n.tokens, CASE WHEN s.n < 4 AND s.used + n.tokens + 12 <= 1000 THEN s.used + n.tokens + 12 ELSE s.used END,
  CASE WHEN s.n < 4 AND s.used + n.tokens + 12 <= 1000 THEN s.n + 1 ELSE s.n END, s.n < 4 AND s.used + n.tokens + 12 <= 1000 FROM steps s JOIN near n ON n.query_id = s.query_id AND n.k = s.k + 1)
SELECT query_id, doc_id, chunk_no::BIGINT AS chunk_no, score, tokens, n::BIGINT AS pick FROM steps WHERE took""",
    "prefill_documents": f"""WITH RECURSIVE {CHUNKS} SELECT * FROM (SELECT doc_id, chunk_no::BIGINT AS chunk_no, tokens, sum(tokens + 12) OVER (ORDER BY doc_id, chunk_no)::BIGINT AS running FROM chunks) WHERE running <= 20000""",
}
