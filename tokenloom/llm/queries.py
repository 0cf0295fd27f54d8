"""The queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, action string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_language

    return identify_language(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neural_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import ascii_lower
    from .merkle import folded, manifest, path_digest

    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, ascii_lower(docs["text"])).otherwise(docs["text"])
    found = manifest(docs, claims={"text": tampered}).withColumn("folded_root", folded(F.col("claim"), F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", verified)


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import count_words, variant_groups

    return variant_groups(count_words(table(spark, sf_dir, "documents"), damage=("doc_id", 97)))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_secrets": op4_secrets,
    "op5_media": op5_media,
    "op6_html_extract": op6_html_extract,
    "op7_packing": op7_packing,
    "op8_decontaminate": op8_decontaminate,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_neural_lm": op10_neural_lm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_forest": op12_minhash_forest,
    "op13_spelling_variants": op13_spelling_variants,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: CRC-32: a table of 256 entries by eight steps each, then a fold over the bytes; the start and the end invert all bits.
_CRC_TABLE = """crc_steps(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves(tree, i, d, n)``: (tree, l, i, d, n)."""
    return f"""{name}(tree, l, i, d, n) AS (SELECT tree, 0, i, d, n FROM {leaves}
  UNION ALL SELECT tree, l + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, l, i // 16, n)"""

def _links(k: int, percent: int) -> str:
    """(doc_id, n_shingles, component_id) by all pairs of documents with a common ``k``-word shingle."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
linked AS (SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id))"""


ORACLE_SQL = {
    "op9_jaccard_join": f"{_links(5, 75)} SELECT * FROM linked",
    "op12_minhash_forest": f"{_links(4, 80)} SELECT *, doc_id = component_id AS kept FROM linked",
    "op1_url_filter": f"""
WITH rules(h, p, a) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT s.*, h || p AS rule, a, length(h || p) * 1000 + length(h) AS rank FROM s LEFT JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, max_by(rule, rank) AS rule, coalesce(max_by(a, rank), 'allow') AS verdict
FROM m GROUP BY page_id, host, path""",
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
held AS (SELECT doc_id, source, unnest(list_distinct(list_transform(list_filter(ls, lambda x: trim(x) <> ''), lambda x: trim(x)))) AS line FROM d),
counts AS (SELECT source, line, count(*) AS n FROM held GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
bad AS (SELECT source, list(line) AS lines FROM counts JOIN totals USING (source) WHERE n >= 5 AND n > total * 0.05 GROUP BY source),
k AS (SELECT d.*, list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(lines, []), trim(x))) AS kept FROM d LEFT JOIN bad USING (source))
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, len(ls) AS n_lines, len(ls) - len(kept) AS n_dropped FROM k""",
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(string_split(win, ' ')) AS k FROM win),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, lens WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, win.item_id FROM dw JOIN win ON array_to_string(dw.w[i:i + k - 1], ' ') = win.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS it FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0 AS hit FROM documents, crc),
lv AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf, {_leaf(f"CASE WHEN hit THEN translate(text, '{_UP}', '{_LOW}') ELSE text END")} AS claim FROM d),
base AS (SELECT doc_id, tree, leaf AS d, claim, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM lv),
{_tree('inner_tree', 'base')},
sub AS (SELECT '' AS tree, tree AS name, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
{_tree('outer_tree', 'sub')},
top AS (SELECT d AS root FROM outer_tree WHERE n = 1),
sibling AS (
  SELECT b.doc_id, 0 AS part, t.l, t.i < b.i // 16::BIGINT ** t.l AS before, t.i, t.d FROM base b JOIN inner_tree t ON t.tree = b.tree AND t.n > 1
    AND t.i // 16 = b.i // (16::BIGINT ** (t.l + 1))::BIGINT AND t.i <> b.i // (16::BIGINT ** t.l)::BIGINT
  UNION ALL
  SELECT b.doc_id, 1, t.l, t.i < s.i // 16::BIGINT ** t.l, t.i, t.d FROM base b JOIN sub s ON s.name = b.tree JOIN outer_tree t ON t.n > 1
    AND t.i // 16 = s.i // (16::BIGINT ** (t.l + 1))::BIGINT AND t.i <> s.i // (16::BIGINT ** t.l)::BIGINT),
steps AS (SELECT DISTINCT b.doc_id, 0 AS part, t.l FROM base b JOIN inner_tree t ON t.tree = b.tree AND t.n > 1 UNION ALL SELECT b.doc_id, 1, o.l FROM base b, (SELECT DISTINCT l FROM outer_tree WHERE n > 1) o),
sided AS (SELECT t.doc_id, t.part, t.l, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.part, t.l) AS k,
  coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE s.before), '') AS lft, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE NOT s.before), '') AS rgt
  FROM steps t LEFT JOIN sibling s USING (doc_id, part, l) GROUP BY t.doc_id, t.part, t.l),
fold(doc_id, k, d) AS (SELECT doc_id, 0, claim FROM base UNION ALL SELECT f.doc_id, s.k, sha256(s.lft || f.d || s.rgt) FROM fold f JOIN sided s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
ends AS (SELECT doc_id, max_by(d, k) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS p FROM sided GROUP BY doc_id)
SELECT b.doc_id, b.d AS leaf, s.d AS subroot, top.root, coalesce(p.p, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
FROM base b JOIN sub s ON s.name = b.tree JOIN ends e ON e.doc_id = b.doc_id LEFT JOIN proof p ON p.doc_id = b.doc_id, top""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT doc_id, w, n, {_crc("flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))")} AS h FROM dw, crc),
k AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
dels AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM dels a JOIN words w ON w.word = a.d UNION SELECT w.word, w.n, a.word, a.n FROM dels a JOIN words w ON w.word = a.d),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk(word, goal) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.goal WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.goal AS root FROM walk JOIN f ON f.word = walk.goal WHERE f.form IS NULL)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)""",
}
