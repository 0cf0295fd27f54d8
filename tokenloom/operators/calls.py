"""Planned model calls: windows, chunks, routed prompts, coverage, cost and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import next_fit
from ..functions.phrases import phrases_in
from ..functions.scan import next_fit_bins
from ..functions.text import COUNTERS, Counter, call_cost, lines, normalise_ws, per_thousand, render_page, token_count
from ..sources.scratch import small, written
from .pages import render_pages

# Model profiles (prices in USD per million tokens, null where there is none).
PROFILES = [
    ("estimate", "Estimated counter", 200_000, None, None),
    ("small", "Small hosted model", 400_000, 0.25, 2.00),
    ("long", "Long-context model", 1_048_576, 0.30, 2.50),
    ("local", "Local 8k model", 8_192, 0.0, 0.0),
]
#: Framing of a call, its routed output, the least room for a chunk.
FRAME, ROUTED_OUT, LEAST_ROOM = 24, 1024, 200


def profiles(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(PROFILES, "model_key string, label string, context_window long, price_in double, price_out double")
    return df.withColumn("max_out", F.least(F.lit(4096), F.floor(F.col("context_window") / 4)).cast("long"))


def plan_full(pages: DataFrame, models: DataFrame, prompt_tokens: int) -> DataFrame:
    """(pack_id, model_key, tokens_in, max_out, fits): a whole pack in one call."""
    packs = pages.groupBy("pack_id").agg(F.sum(token_count(F.col("text"))).alias("t"))
    rows = packs.crossJoin(F.broadcast(models)).withColumn("tokens_in", F.col("t") + prompt_tokens + FRAME)
    return rows.select("pack_id", "model_key", "tokens_in", "max_out", (F.col("tokens_in") + F.col("max_out") <= F.col("context_window")).alias("fits"))


def split_oversize_pages(pages: DataFrame, room: Column | int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(…, piece_no, text, tokens): a page over the room is cut between lines; one over-long line stays whole."""
    room = F.lit(room) if isinstance(room, int) else room
    whole = token_count(F.col("text"))
    marked = pages.select(*keys, "pack_id", "page_no", "text", room.cast("long").alias("cap"), whole.alias("whole"))
    cut = marked.withColumn("ls", F.when(F.col("whole") > F.col("cap"), lines(F.col("text"))).otherwise(F.array("text")))
    binned = cut.withColumn("bins", next_fit(F.when(F.col("whole") > F.col("cap"), F.transform("ls", token_count)).otherwise(F.array("whole")), F.col("cap")))
    rows = binned.select(*keys, "pack_id", "page_no", "ls", F.posexplode("bins").alias("piece_no", "b"))
    return rows.select(*keys, "pack_id", "page_no", "piece_no", F.array_join(F.slice("ls", F.col("b.first") + 1, F.col("b.n")), "\n").alias("text"), F.col("b.tokens").alias("tokens"))


def chunk_packs(pages: DataFrame, models: DataFrame, overhead: int, output_share: float = 0.1) -> DataFrame:
    """(pack_id, model_key, status, n_chunks, tokens_in, tokens_out, merge_in): pieces next-fit into calls.

    Room is the window less the output and the prompt; under 200 tokens the status is ``no_room``. A chunk's
    reply is reckoned at ``output_share`` of its text; the merge call holds all replies and must fit
    too, else ``merge_too_big``. A page's tokens are counted once for all models, and only pages over a model's room are
    split for it; pieces are put into calls by ``next_fit_bins``, so a pack may be as long as the table."""
    sized = models.withColumn("room", F.col("context_window") - F.col("max_out") - overhead)
    fit = sized.where(F.col("room") >= LEAST_ROOM).select("model_key", F.col("room").cast("long").alias("room"))
    counted = written(pages.select("pack_id", "page_no", token_count(F.col("text")).alias("tokens"))).crossJoin(F.broadcast(fit))
    over = counted.where(F.col("tokens") > F.col("room")).select("pack_id", "page_no", "model_key", "room")
    cut = split_oversize_pages(pages.select("pack_id", "page_no", "text").join(over, ["pack_id", "page_no"]), F.col("room"), ("model_key", "room"))
    whole = counted.where(F.col("tokens") <= F.col("room")).withColumn("piece_no", F.lit(0))
    columns = ["pack_id", "model_key", "room", "page_no", "piece_no", "tokens"]
    bins = next_fit_bins(whole.select(*columns).unionByName(cut.select(*columns)), ["pack_id", "model_key"], ["page_no", "piece_no"], "tokens", "room")
    out = F.ceil(F.col("tokens") * output_share).cast("long")
    called = bins.groupBy("pack_id", "model_key").agg(F.count("*").alias("n_chunks"), F.sum(F.col("tokens") + overhead).alias("chunks_in"), F.sum(out).alias("chunks_out"))
    rows = pages.select("pack_id").distinct().crossJoin(F.broadcast(sized)).join(called, ["pack_id", "model_key"], "left")
    merge_in = F.col("chunks_out") + overhead
    status = F.when(F.col("room") < LEAST_ROOM, "no_room").when(F.col("n_chunks") <= 1, "one_call").when(merge_in + F.col("max_out") > F.col("context_window"), "merge_too_big").otherwise("merged")
    merges = F.col("n_chunks") > 1
    return rows.select(
        "pack_id", "model_key", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        (F.col("chunks_in") + F.when(merges, merge_in).otherwise(0)).alias("tokens_in"), (F.col("chunks_out") + F.when(merges, F.col("chunks_out")).otherwise(0)).alias("tokens_out"),
        F.when(merges, merge_in).alias("merge_in"),
    )


def plan_routed(routed: DataFrame, packs: DataFrame, tasks: list[str], models: DataFrame, prompt_tokens: int) -> DataFrame:
    """(pack_id, task, model_key, tokens_in, max_out, fits): one call for every pack and task, pages or none.

    Token counts add up over white space, so pages are counted one by one and their text is never joined."""
    all_tasks = packs.select("pack_id").distinct().withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    sizes = routed.groupBy("pack_id", "task").agg(F.sum(token_count(render_page(F.col("kind"), F.col("page_no"), F.col("text")))).alias("t"))
    rows = all_tasks.join(sizes, ["pack_id", "task"], "left")
    rows = rows.withColumn("tokens_in", F.coalesce("t", F.lit(0)) + prompt_tokens + FRAME).crossJoin(F.broadcast(models.select("model_key", "context_window")))
    return rows.select("pack_id", "task", "model_key", "tokens_in", F.lit(ROUTED_OUT).cast("long").alias("max_out"), (F.col("tokens_in") + ROUTED_OUT <= F.col("context_window")).alias("fits"))


def _of_packs(rows: DataFrame) -> list[str]:
    """Evidence without a pack_id is every pack's."""
    return ["pack_id"] if "pack_id" in rows.columns else []


def covered_fields(calls: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """(call, field_key): the fields all of whose phrases stand in the call, white space apart.

    ``evidence(pack_id, field_key, phrase)`` is looked for in its pack; without ``pack_id`` every pack looks for all of it, and it is not repeated for
    each. Calls are read once for all phrases, see ``phrases_in``; phrases of any length are found, at words' edges and inside of them."""
    at = _of_packs(evidence)
    text = calls.select("pack_id", *keys, normalise_ws(F.col("text")).alias("text"))
    phrases = written(evidence.select(*at, "field_key", normalise_ws(F.col("phrase")).alias("phrase")).distinct())
    needed = phrases.groupBy(*at, "field_key").agg(F.count("*").alias("needed"))
    # An empty phrase stands in every call.
    empty, full = phrases.where("phrase = ''").select(*at, "field_key"), text.where("text is not null").select("pack_id", *keys)
    if not at:
        full = full.where("pack_id is not null")
    empty = full.join(empty, at) if at else full.crossJoin(small(written(empty)))
    found = phrases_in(text if at else text.where("pack_id is not null"), phrases, tuple(at)).join(phrases if at else small(phrases), [*at, "phrase"]).select("pack_id", *keys, "field_key", "phrase")
    held = found.unionByName(empty.withColumn("phrase", F.lit(""))).groupBy("pack_id", *keys, "field_key").agg(F.count_distinct("phrase").alias("held"))
    if not at:
        needed = small(written(needed))
    return held.join(needed, [*at, "field_key"]).where(F.col("held") == F.col("needed")).select("pack_id", *keys, "field_key")


def field_task(evidence: DataFrame, groups: dict[str, dict[str, list[str] | None]]) -> DataFrame:
    """Adds ``task``: the first whose groups own the field, else ``?``.

    A key is ``group.sub``; ``groups`` names for each task its groups, each with the subs it owns, or None for all."""
    group, sub = F.substring_index("field_key", ".", 1), F.regexp_extract("field_key", r"^[^.]*\.?(?s)(.*)$", 1)
    owned = [
        F.when((group == g.removesuffix("[]")) & (F.lit(True) if only is None else sub.isin(only)), F.lit(task)) for task, owns in groups.items() for g, only in owns.items()
    ]
    return evidence.withColumn("task", F.coalesce(*owned, F.lit("?")))


def leaf_tokens(key: Column, value: Column, wrapped: bool) -> Column:
    """Tokens of a field in a reference answer, its comma included; counts add up over punctuation."""
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    if wrapped:
        quoted = F.concat(F.lit('{"value":'), quoted, F.lit(',"source_quote":'), quoted, F.lit(',"confidence":0.95}'))
    return token_count(F.concat(F.lit('"'), key, F.lit('":'), quoted, F.lit(",")))


def answer_tokens(fields: DataFrame, by: list[str], wrapped: bool) -> DataFrame:
    """(by, tokens_out): the size of each reference answer over its ``fields(*by, field_key, value)``; no field, no row."""
    return fields.groupBy(*by).agg((F.sum(leaf_tokens(F.col("field_key"), F.col("value"), wrapped)) + 1).alias("tokens_out"))


#: The size of an answer without any field.
EMPTY_ANSWER = 2
CALL = ("pack_id", "model_key", "call_no", "task", "tokens_in", "tokens_out", "max_out", "fits", "covers")


def _answered(calls: DataFrame, covered: DataFrame, values: DataFrame, wrapped: bool) -> DataFrame:
    """Adds covers (sorted keys) and tokens_out to calls, from ``covered(pack_id, model_key, call_no, field_key)``."""
    at = ["pack_id", "model_key", "call_no"]
    mine = [*_of_packs(values), "field_key"]
    sized = answer_tokens(covered.join(values if len(mine) > 1 else small(written(values)), mine), at, wrapped)
    listed = covered.groupBy(*at).agg(F.array_sort(F.collect_set("field_key")).alias("covers"))
    found = calls.join(listed, at, "left").join(sized, at, "left")
    return found.withColumn("covers", F.coalesce("covers", F.array().cast("array<string>"))).withColumn("tokens_out", F.coalesce("tokens_out", F.lit(EMPTY_ANSWER)).cast("long"))


def full_calls(pages: DataFrame, models: DataFrame, evidence: DataFrame, prompt_tokens: int) -> DataFrame:
    """The calls of the full pipeline, with text: one for a pack that fits the window, else chunks and a merge.

    Columns: pack_id, model_key, call_no, task, tokens_in, tokens_out, max_out, fits, covers, text. Chunks are
    next-fit over pages cut to the room; a chunk's answer holds the fields it covers, the merge call reads all answers
    and covers what some chunk covers whole. A pack for which the prompt leaves no room has one call that does not fit.
    The reply's size is that of the wrapped reference answer. A pack's text becomes rows, so packs are to be of bounded size."""
    values = evidence.groupBy(*_of_packs(evidence), "field_key").agg(F.min("phrase").alias("value"))
    sized = models.withColumn("room", F.col("context_window") - F.col("max_out") - prompt_tokens - FRAME)
    whole = pages.groupBy("pack_id").agg(F.sum(token_count(F.col("text"))).alias("t"))
    planned = whole.crossJoin(F.broadcast(sized.select("model_key", "room", "max_out"))).withColumn("one", F.col("t") <= F.col("room"))
    single = planned.where("one").select("pack_id", "model_key", F.lit(1).cast("long").alias("call_no"), F.lit("all").alias("task"), F.col("t").alias("tokens"), "max_out", F.lit(True).alias("fits"))
    stuck = planned.where(~F.col("one") & (F.col("room") < LEAST_ROOM)).select(
        "pack_id", "model_key", F.lit(1).cast("long").alias("call_no"), F.lit("no_room").alias("task"), F.col("t").alias("tokens"), "max_out", F.lit(False).alias("fits")
    )
    cut = planned.where(~F.col("one") & (F.col("room") >= LEAST_ROOM)).select("pack_id", "model_key", "room", "max_out")
    pieces = split_oversize_pages(pages.join(cut, "pack_id"), F.col("room"), ("model_key", "room"))
    order = F.array_sort(F.collect_list(F.struct("page_no", "piece_no", "tokens", "text")))
    binned = pieces.groupBy("pack_id", "model_key", "room").agg(order.alias("p")).withColumn("bins", next_fit(F.transform("p", lambda x: x["tokens"]), F.col("room")))
    rows = binned.select("pack_id", "model_key", "p", F.posexplode("bins").alias("at", "b"))
    text = F.array_join(F.transform(F.slice("p", F.col("b.first") + 1, F.col("b.n")), lambda x: x["text"]), "\n\n")
    chunks = rows.select("pack_id", "model_key", (F.col("at") + 1).cast("long").alias("call_no"), F.col("b.tokens").alias("tokens"), text.alias("text")).join(F.broadcast(models.select("model_key", "max_out", "context_window")), "model_key")
    # One over-long line stays whole, so a chunk may not fit.
    fits = F.col("tokens") + prompt_tokens + FRAME + F.col("max_out") <= F.col("context_window")
    # Read for what they cover, for their sizes and for the merge calls, so written once.
    chunks = written(chunks.select("pack_id", "model_key", "call_no", F.concat(F.lit("chunk "), F.col("call_no").cast("string")).alias("task"), "tokens", "max_out", fits.alias("fits"), "text"))
    texts = pages.groupBy("pack_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    # The same pack's text goes to every model it fits, so its coverage is found once.
    at = ("model_key", "call_no")
    ones = covered_fields(texts.withColumn("call_no", F.lit(1).cast("long")), evidence, ("call_no",)).join(single.select("pack_id", "model_key"), "pack_id").select("pack_id", *at, "field_key")
    parts = covered_fields(chunks, evidence, at)
    last = chunks.groupBy("pack_id", "model_key").agg((F.max("call_no") + 1).alias("call_no"))
    merged = parts.select("pack_id", "model_key", "field_key").distinct().join(last, ["pack_id", "model_key"]).select("pack_id", *at, "field_key")
    told = _answered(chunks, parts, values, True)
    merges = told.groupBy("pack_id", "model_key").agg(F.sum("tokens_out").alias("tokens")).join(last, ["pack_id", "model_key"]).join(F.broadcast(models.select("model_key", "max_out", "context_window")), "model_key")
    merges = merges.select("pack_id", "model_key", "call_no", F.lit("merge").alias("task"), "tokens", "max_out", fits.alias("fits"), F.lit(None).cast("string").alias("text"))
    direct = _answered(single.unionByName(stuck).join(texts, "pack_id", "left"), ones, values, True)
    calls = direct.unionByName(told).unionByName(_answered(merges, merged, values, True))
    return calls.withColumn("tokens_in", F.col("tokens") + prompt_tokens + FRAME).select(*CALL, "text")


def routed_calls(routed: DataFrame, packs: DataFrame, evidence: DataFrame, groups: dict[str, dict[str, list[str] | None]], models: DataFrame, prompt_tokens: int) -> DataFrame:
    """The calls of the routed pipeline: for every pack, model and task its pages, and the task's own fields that they cover.

    The reply's size is that of the plain reference answer with all fields of the task."""
    owned = field_task(evidence, groups)
    planned = plan_routed(routed, packs, sorted(groups), models, prompt_tokens)
    numbers = {t: i + 1 for i, t in enumerate(sorted(groups))}
    number = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    texts = render_pages(routed, ("pack_id", "task")).withColumnRenamed("rendered", "text")
    at = _of_packs(evidence)
    covered = covered_fields(texts, evidence, ("task",)).join(owned.select(*at, "field_key", "task").distinct(), [*at, "field_key", "task"])
    listed = covered.groupBy("pack_id", "task").agg(F.array_sort(F.collect_set("field_key")).alias("covers"))
    values = owned.groupBy(*at, "task", "field_key").agg(F.min("phrase").alias("value"))
    sized = answer_tokens(values, [*at, "task"], False)
    rows = planned.join(listed, ["pack_id", "task"], "left").join(sized if at else F.broadcast(sized), [*at, "task"], "left").join(texts, ["pack_id", "task"], "left")
    return rows.withColumn("covers", F.coalesce("covers", F.array().cast("array<string>"))).withColumn("tokens_out", F.coalesce("tokens_out", F.lit(EMPTY_ANSWER)).cast("long")).withColumn(
        "call_no", number[F.col("task")].cast("long")
    ).select(*CALL, "text")


def final_coverage(covered: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct covered fields over the calls of each key."""
    return covered.select(*by, "field_key").distinct()


def produced_fields(full: DataFrame, routed: DataFrame) -> DataFrame:
    """(pack_id, model_key, pipeline, field_key): what each pipeline's result can hold: the covers of the last full call, of any routed one."""
    last = full.groupBy("pack_id", "model_key").agg(F.max_by("covers", "call_no").alias("covers"))
    rows = last.withColumn("pipeline", F.lit("full")).unionByName(routed.select("pack_id", "model_key", "covers").withColumn("pipeline", F.lit("routed")))
    return rows.select("pack_id", "model_key", "pipeline", F.explode("covers").alias("field_key")).distinct()


def missed_fields(evidence: DataFrame, final: DataFrame) -> DataFrame:
    return evidence.select("pack_id", "field_key").distinct().join(final.select("pack_id", "field_key").distinct(), ["pack_id", "field_key"], "left_anti")


def model_cost(calls: DataFrame, models: DataFrame) -> DataFrame:
    priced = calls.join(F.broadcast(models.select("model_key", "price_in", "price_out")), "model_key")
    return priced.withColumn("cost", call_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))).drop("price_in", "price_out")


def pipeline_report(calls: DataFrame, fields: DataFrame, models: DataFrame) -> DataFrame:
    """Per model and pipeline: packs, failed packs, calls, tokens, cost, covered fields, fields per 1,000 tokens, saving against ``full``.

    ``calls(pack_id, model_key, pipeline, tokens_in, tokens_out, fits)`` has a row per call, ``fields(pack_id, model_key,
    pipeline, field_key)`` what results hold. A pack with a call that does not fit cannot be done: it counts as failed and in nothing else.
    The saving is over the packs that both pipelines can do."""
    at = ["pack_id", "model_key", "pipeline"]
    packs = calls.groupBy(*at).agg(F.bool_and("fits").alias("fits"), F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    held = fields.groupBy(*at).agg(F.count("*").alias("fields"))
    packs = packs.join(held, at, "left").fillna(0, ["fields"])
    done = F.col("fits")
    sums = packs.groupBy("model_key", "pipeline").agg(
        F.count("*").alias("packs"), F.count_if(~done).alias("failed"), *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("calls", "tokens_in", "tokens_out", "fields")]
    )
    tokens = packs.where(done).select("pack_id", "model_key", "pipeline", (F.col("tokens_in") + F.col("tokens_out")).alias("own"))
    both = tokens.join(tokens.where("pipeline = 'full'").select("pack_id", "model_key", F.col("own").alias("base")), ["pack_id", "model_key"])
    saved = both.groupBy("model_key", "pipeline").agg(F.round(1 - F.sum("own") / F.sum("base"), 6).alias("saving"))
    rows = model_cost(sums, models).join(saved, ["model_key", "pipeline"], "left").withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    return rows.select(
        "model_key", "pipeline", "packs", "failed", "calls", "tokens_in", "tokens_out", "tokens", F.round("cost", 6).alias("cost"), "fields",
        per_thousand(F.col("fields"), F.col("tokens")).alias("fields_per_1k"), "saving",
    )


def counter_effect(samples: DataFrame, counters: dict[str, Counter] = COUNTERS, base: str = "heuristic") -> DataFrame:
    """Per sample: tokens by each counter, and their ratio to the base counter. ``samples(sample, text)``."""
    counted = samples.groupBy("sample").agg(*[F.sum(f(F.col("text"))).alias(k) for k, f in counters.items()])
    return counted.select("*", *[F.round(F.col(k) / F.col(base), 6).alias(f"{k}_ratio") for k in counters if k != base])
