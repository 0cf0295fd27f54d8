"""Page cleaning: repeated lines, duplicates, kinds, shared boilerplate, routes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.phrases import phrases_in
from ..functions.runs import run_key, runs_held
from ..functions.scan import sums_before
from ..functions.text import LINE_BREAK, SPACE, line_shape, lines, normalise_ws, render_page, rstrip, strip, token_count
from ..sources.scratch import beside, small, written

# The ordered rules for claim packs (first match wins), routes and boilerplate kinds.
CLAIM_RULES = [
    ("fax_cover", r"fax transmission"),
    ("claim_form_declaration", r"claim form - declaration"),
    ("claim_form", r"claim form"),
    ("pre_authorisation", r"pre-authorisation confirmation"),
    ("discharge_summary", r"discharge summary"),
    ("lab_report", r"laboratory report"),
    ("radiology", r"radiology report"),
    ("invoice", r"invoice|tax invoice"),
    ("pharmacy", r"pharmacy receipt"),
    ("correspondence", r"email correspondence|^from: "),
    ("policy_schedule", r"policy schedule"),
    ("terms", r"terms and conditions"),
    ("privacy", r"privacy notice"),
]
CLAIM_ROUTES = {"member": ["claim_form"], "clinical": ["discharge_summary"], "financial": ["pre_authorisation", "invoice", "pharmacy", "correspondence"]}
BOILERPLATE_KINDS = ("terms", "privacy", "claim_form_declaration")
PAGE_NUMBER = rf"(?i)^{SPACE}*page \p{{Nd}}+ of \p{{Nd}}+{SPACE}*$"


def load_pages(df: DataFrame, pack: str, page_no: str, text: str) -> DataFrame:
    """pages(pack_id, page_no, text); a null text is empty."""
    return df.select(F.col(pack).alias("pack_id"), F.col(page_no).alias("page_no"), F.coalesce(text, F.lit("")).alias("text"))


def repeated_lines(pages: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Shapes on at least ``ratio`` of the pack's pages: (pack_id, shape, n_pages, pack_pages)."""
    shapes = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_shape), lambda s: s != ""))
    counts = pages.select("pack_id", F.explode(shapes).alias("shape")).groupBy("pack_id", "shape").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy("pack_id").agg(F.count("*").alias("pack_pages"))
    return counts.join(totals, "pack_id").where(F.col("n_pages") >= F.col("pack_pages") * F.lit(ratio))


def clean_pages(pages: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Text without headers, footers, page numbers, quoted replies, blank lines and table padding.

    A pack has at most lines-per-page / ratio repeated shapes, so their list stays short. While all lists together are short they go to
    the pages, which stay where they are: dealt by pack, a few large packs would be a few tasks."""
    repeated = written(repeated_lines(pages, ratio).select("pack_id", "shape"))
    shapes = beside(repeated, repeated.groupBy("pack_id").agg(F.collect_set("shape").alias("repeated")))
    joined = pages.join(shapes, "pack_id", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))
    # A line's shape is blank, begins as a quote or as a page number only if the line, stripped, does.
    shaped = F.transform(lines(F.col("text")), lambda x: F.struct(x.alias("line"), line_shape(x).alias("shape")))
    kept = F.filter(
        shaped,
        lambda x: (x["shape"] != "") & ~F.startswith(x["shape"], F.lit(">")) & ~(F.startswith(x["shape"], F.lit("page ")) & x["line"].rlike(PAGE_NUMBER)) & ~F.array_contains(F.col("repeated"), x["shape"]),
    )
    text = F.array_join(F.transform(kept, lambda x: F.regexp_replace(rstrip(x["line"]), r"[ \t]{2,}", "  ")), "\n")
    return joined.withColumn("text", text).drop("repeated")


def drop_duplicate_pages(pages: DataFrame) -> DataFrame:
    """Adds dropped_reason: the pack's first page with the same text, stamp lines apart, keeps; rows stay.

    First pages are found by a partial aggregate, so a text that many pages share (an empty one, say) is no task's burden."""
    key = F.array_join(F.filter(lines(F.col("text")), lambda x: ~F.contains(F.lower(x), F.lit("duplicate"))), "\n")
    keyed = written(pages.withColumn("dup_key", F.sha2(key, 256)))  # cleaning, say, is not done once more for the first pages
    firsts = keyed.groupBy("pack_id", "dup_key").agg(F.min("page_no").alias("first_no"), F.count("*").alias("same")).where("same > 1").drop("same")
    firsts = small(written(firsts))  # few: the texts stay where they are
    first = F.col("first_no")
    reason = F.when(F.col("page_no") > first, F.concat(F.lit("duplicate of page "), first.cast("string")))
    return keyed.join(firsts, ["pack_id", "dup_key"], "left").withColumn("dropped_reason", reason).select(*pages.columns, "dropped_reason")


def classify_pages(pages: DataFrame, rules: list[tuple[str, str]] = CLAIM_RULES) -> DataFrame:
    first = F.split(F.coalesce("text", F.lit("")), LINE_BREAK, 4)  # what follows the third line stays in one piece
    head = F.lower(F.array_join(F.slice(first, 1, 3), "\n"))
    kind = F.coalesce(*[F.when(F.col("page_head").rlike(f"(?m){p}"), F.lit(k)) for k, p in rules], F.lit("unknown"))
    return pages.withColumn("page_head", head).withColumn("kind", kind).drop("page_head")


def boilerplate_sentences(pages: DataFrame, kinds: tuple[str, ...] = BOILERPLATE_KINDS, least: int = 40) -> DataFrame:
    """Distinct (pack_id, sentence) over the pack's boilerplate pages joined in page order.

    A sentence may run over a page's end, so pieces are numbered through the pack: a page's first piece goes on with the last
    of the page before, and what earlier pages hold is a sum by blocks of pages (``sums_before``). A pack's pages are never
    in one task, nor its text."""
    source = pages.where(F.col("kind").isin(*kinds)).select("pack_id", "page_no", normalise_ws(F.col("text")).alias("flat"))
    ends = source.groupBy("pack_id").agg(F.max("page_no").alias("last_no"))
    source = source.join(ends, "pack_id").withColumn("flat", F.when(F.col("page_no") == F.col("last_no"), F.col("flat")).otherwise(F.concat("flat", F.lit(" "))))
    source = source.withColumn("flat", F.regexp_replace("flat", rf"(?<![\p{{L}}\p{{N}}_])\p{{Nd}}+\.{SPACE}", ""))
    # A page that ends after .!? leaves an empty last piece, so the next page's first piece begins anew there.
    split = written(source.select("pack_id", "page_no", F.split("flat", rf"(?<=[.!?]){SPACE}+").alias("pieces")))
    starts = sums_before(split.select("pack_id", "page_no", (F.size("pieces") - 1).alias("more")), ["pack_id"], ["page_no"], {"before": "more"})
    numbered = split.join(starts, ["pack_id", "page_no"]).select("pack_id", "page_no", "before", F.posexplode("pieces").alias("i", "piece")).withColumn("s", F.col("before") + F.col("i"))
    whole = numbered.groupBy("pack_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "i", "piece"))), lambda x: x["piece"]), "").alias("sentence"))
    return whole.select("pack_id", strip(F.col("sentence")).alias("sentence")).where(F.char_length("sentence") > least).distinct()


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, sentences: pd.Series) -> pd.Series:
    def one(t: str, found) -> str:
        flat = re.sub(r"\s+", " ", t)
        for s in sorted((s for s in found if s in flat), key=lambda s: (-len(s), s)):
            t = re.sub(r"\s+".join(map(re.escape, s.split())), "", t)
        return t

    return pd.Series([one(t, f) if f is not None and len(f) else t for t, f in zip(text, sentences, strict=True)], dtype=object)


def strip_boilerplate(pages: DataFrame, kinds: tuple[str, ...] = BOILERPLATE_KINDS, least: int = 40) -> DataFrame:
    """Removes the pack's boilerplate sentences from its other, not dropped, pages; adds notes.

    A page can only hold a sentence whose inner words it holds in a row, so sentences and pages meet on a hash of up to twelve of
    them (``runs_held``: of a page's runs only those are shuffled that may be some sentence's), or by ``phrases_in`` where a sentence
    has no inner word; longer sentences are removed first."""
    pages = written(pages)
    words = F.split(strip(F.col("sentence")), rf"{SPACE}+")
    inner = F.when(F.size(words) >= 3, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    sentences = written(boilerplate_sentences(pages, kinds, least).withColumn("inner", inner))
    enough, key = run_key(F.col("inner"))
    anchored = written(sentences.where(enough).select("pack_id", "sentence", key.alias("key")))
    live = ~F.col("kind").isin(*kinds) & F.col("dropped_reason").isNull()
    split_pages = pages.where(live).select("pack_id", "page_no", F.split(strip(F.col("text")), rf"{SPACE}+").alias("words"))
    found = runs_held(split_pages, "words", anchored.select("key")).join(anchored, ["pack_id", "key"]).select("pack_id", "page_no", "sentence")
    flat = pages.where(live).select("pack_id", "page_no", normalise_ws(F.col("text")).alias("text"))
    found = found.unionByName(phrases_in(flat, sentences.where(~enough).select("pack_id", "sentence"), ("pack_id",), phrase="sentence"))
    found = found.groupBy("pack_id", "page_no").agg(F.collect_set("sentence").alias("sentences"))
    joined = pages.join(found, ["pack_id", "page_no"], "left").withColumn("cut", F.when(live, _without("text", "sentences")))
    kept = F.filter(lines(F.col("cut")), lambda x: ~x.rlike(rf"^{SPACE}*(\p{{Nd}}+\.)?{SPACE}*$"))
    # An empty text has no lines at all.
    before = F.when(F.col("text") == "", 0).otherwise(F.size(lines(F.col("text"))))
    note = F.when(live & (F.size(kept) != before), F.array(F.lit("shared boilerplate removed"))).otherwise(F.array().cast("array<string>"))
    text = F.when(live, F.array_join(F.transform(kept, rstrip), "\n")).otherwise(F.col("text"))
    return joined.withColumn("notes", note).withColumn("text", text).drop("cut", "sentences")


def routes_table(pages: DataFrame, routes: dict[str, list[str]]) -> DataFrame:
    return F.broadcast(pages.sparkSession.createDataFrame([(t, k) for t, ks in routes.items() for k in ks], "task string, kind string"))


def route_pages(pages: DataFrame, routes: dict[str, list[str]] = CLAIM_ROUTES) -> DataFrame:
    return pages.where("dropped_reason is null").join(routes_table(pages, routes), "kind")


def prepare(pages: DataFrame, ratio: float = 0.5, rules=CLAIM_RULES, kinds=BOILERPLATE_KINDS) -> DataFrame:
    """Cleaned, deduplicated, classified and stripped pages, all rows flagged rather than removed."""
    return strip_boilerplate(classify_pages(drop_duplicate_pages(clean_pages(pages, ratio)), rules), kinds)


def tokens_by_kind(raw: DataFrame, cleaned: DataFrame, routes: dict[str, list[str]], by: tuple[str, ...] = ()) -> DataFrame:
    """Per kind: pages, raw tokens, and tokens of the routed pages: those of a kind that some route takes, not dropped."""
    routed = F.col("dropped_reason").isNull() & F.col("kind").isin(*sorted({k for kinds in routes.values() for k in kinds}))
    sent = F.when(routed, token_count(F.col("text"))).otherwise(0).alias("sent")
    joined = cleaned.select("pack_id", "page_no", "kind", sent).join(raw.select("pack_id", "page_no", token_count(F.col("text")).alias("raw")), ["pack_id", "page_no"])
    return joined.groupBy(*by, "kind").agg(F.count("*").alias("pages"), F.sum("raw").alias("raw_tokens"), F.sum("sent").alias("sent_tokens"))


def render_pages(pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pages of each key in page order, rendered and joined."""
    return pages.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", render_page(F.col("kind"), F.col("page_no"), F.col("text")).alias("r")))), lambda x: x["r"]), "\n").alias("rendered")
    )
