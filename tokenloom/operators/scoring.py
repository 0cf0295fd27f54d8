"""Reply merging, field scores, evidence and answer checks, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.phrases import phrases_in
from ..functions.text import json_body, normalise_loose, per_thousand, plain_value, values_match
from ..sources.scratch import written


# Fixed value: the fields of a wrapped leaf.
LEAF = ("value", "source_quote", "confidence")


def _mapped(value: Column, kind: T.DataType, leaf) -> Column:
    """A value of that type with ``leaf(column, type)`` in place of its leaves, whatever structs and arrays they are in."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _mapped(x, kind.elementType, leaf))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_mapped(value[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields]))
    return leaf(value, kind)


def wrap_leaves(value: Column, kind: T.DataType) -> Column:
    """Every leaf as {value, source_quote, confidence}."""
    return _mapped(value, kind, lambda x, _: F.struct(x.alias("value"), x.cast("string").alias("source_quote"), F.lit(0.95).alias("confidence")))


def unwrap(value: Column, kind: T.DataType) -> Column:
    """The plain value: a struct of no other fields than {value, source_quote, confidence} is its value, at every depth."""
    if isinstance(kind, T.StructType):
        if "value" in kind.names and set(kind.names) <= set(LEAF):
            return unwrap(value["value"], kind["value"].dataType)
        return F.when(value.isNotNull(), F.struct(*[unwrap(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unwrap(x, kind.elementType))
    return value


def reference_answers(rows: DataFrame, keys: list[str], fields: list[str], wrapped: bool = False, only: set[str] | None = None) -> DataFrame:
    """Adds ``answer``: minified JSON of the fields, or every leaf as {value, source_quote, confidence}; fields may be nested."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    chosen = [(wrap_leaves(F.col(f), kinds[f]) if wrapped else F.col(f)).alias(f) for f in fields if only is None or f in only]
    return rows.select(*keys, F.to_json(F.struct(*chosen)).alias("answer"))


def first_valid_reply(replies: DataFrame, schema: str, retries: int = 1) -> DataFrame:
    """Per call: the first attempt whose JSON parses. ``replies(call_id, attempt, text)``, attempts from 1."""
    body = json_body(F.col("text"))
    parsed = replies.where(F.col("attempt") <= retries + 1).withColumn("body", body).withColumn("valid", F.expr("try_parse_json(body)").isNotNull())
    summed = parsed.groupBy("call_id").agg(
        F.min_by(F.when(F.col("valid"), F.col("body")), F.when(F.col("valid"), F.col("attempt"))).alias("body"), F.min(F.when(F.col("valid"), F.col("attempt"))).alias("attempt"),
        F.count("*").alias("attempts"),
    )
    return summed.withColumn("reply", F.from_json("body", schema))


def merge_task_results(parts: DataFrame) -> DataFrame:
    """(pack_id, grp, field, value): the latest task's value of each field (ties: the largest); ``parts`` also has task_no."""
    return parts.groupBy("pack_id", "grp", "field").agg(F.max_by("value", F.struct("task_no", "value")).alias("value"))


def usage_report(usage: DataFrame, by: tuple[str, ...] = ("pipeline",), missed: DataFrame | None = None) -> DataFrame:
    """Tokens, reasoning tokens, retries, right fields per 1,000 tokens, and the missed keys of each run.

    ``usage`` has a row per attempt; ``missed(*by, field_key)`` the keys that a run got wrong or not at all."""
    sums = usage.groupBy(*by).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count_if(F.col("attempt") > 1).alias("retries"), F.sum("correct").alias("correct")
    )
    sums = sums.withColumn("correct_per_1k", per_thousand(F.col("correct"), F.col("tokens_in") + F.col("tokens_out")))
    if missed is None:
        return sums
    keys = missed.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("field_key")), ",").alias("missed"))
    return sums.join(keys, list(by), "left").fillna("", ["missed"])


def _scalar_checks(kinds: dict[str, str], e: str, g: str) -> Column:
    """Array of (field_key, correct): scalar fields of the struct ``e`` against those of the struct ``g`` as text."""
    return F.array(*[F.struct(F.lit(k).alias("field_key"), values_match(kind, F.col(f"{e}.{k}"), F.col(f"{g}.{k}").cast("string")).alias("correct")) for k, kind in kinds.items()])


def _told(checks: DataFrame, keys: list[str], *arrays: Column) -> DataFrame:
    """(keys, field_key, correct) of arrays of checks; a null array has none."""
    none = F.array().cast("array<struct<field_key:string,correct:boolean>>")
    return checks.select(*keys, F.explode(F.concat(*[F.coalesce(a, none) for a in arrays])).alias("c")).select(*keys, "c.field_key", "c.correct")


def score_scalars(truth: DataFrame, got: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """(keys, field_key, correct): scalar fields of ``truth`` against the text fields of ``got``."""
    joined = truth.select(*keys, F.struct(*kinds).alias("e")).join(got.select(*keys, F.struct(*kinds).alias("g")), keys, "left")
    return _told(joined, keys, _scalar_checks(kinds, "e", "g"))


def _plain(a: Column) -> Column:
    return plain_value(a.cast("string"))


def _plain_invoices(items: Column) -> Column:
    """Each invoice with its plain number: made once an invoice, not once a pair."""
    return F.transform(items, lambda i: F.struct(i["invoice_number"].cast("string").alias("key"), _plain(i["invoice_number"]).alias("number"), i["amount"].alias("amount")))


def _invoice_checks(e: Column, g: Column, old: Column, prefix: str = "") -> list[Column]:
    """Checks of the expected invoices ``e``, and that none is superseded; both as ``_plain_invoices`` gives them, ``old`` an array of plain numbers."""
    each = F.transform(
        e,
        lambda x: F.struct(
            F.concat(F.lit(prefix), x["key"]).alias("field_key"),
            F.exists(g, lambda i: F.coalesce((i["number"] == x["number"]) & values_match("number", x["amount"], i["amount"].cast("string")), F.lit(False))).alias("correct"),
        ),
    )
    none = F.coalesce((F.size(g) > 0) & ~F.exists(g, lambda i: F.coalesce(F.array_contains(old, i["number"]), F.lit(False))), F.lit(False))
    return [each, F.array(F.struct(F.lit(f"{prefix}no_superseded").alias("field_key"), none.alias("correct")))]


def _old_numbers(superseded: DataFrame, key: str) -> DataFrame:
    return superseded.groupBy(key).agg(F.collect_set(_plain(F.col("invoice_number"))).alias("old"))


def score_invoices(truth: DataFrame, got: DataFrame, superseded: DataFrame, key: str = "pack_id") -> DataFrame:
    """(pack, field_key, correct): each expected invoice's number and amount, and that none is superseded.

    ``truth`` and ``got`` have invoices array<struct<invoice_number, amount>>; ``superseded(pack, invoice_number)``."""
    return score_fields(truth, got, superseded, {}, {}, key, "")


def _plain_codes(items: Column, code: str, primary: str | None, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Each item with its plain code and those that are accepted for it: made once an item, not once a pair."""
    known = F.create_map(*[F.lit(x) for k, v in synonyms.items() for x in (k, ",".join(v))]) if synonyms else None
    accepted = lambda i: [F.transform(F.filter(F.split(F.coalesce(known[i[code]], F.lit("")), ","), lambda o: o != ""), _plain).alias("others")] if synonyms else []
    return F.transform(items, lambda i: F.struct(i[code].cast("string").alias("key"), _plain(i[code]).alias("plain"), *([i[primary].alias("primary")] if primary else []), *accepted(i)))


def _code_checks(e: Column, g: Column, primary: str | None, synonyms: dict[str, list[str]] | None, prefix: str = "") -> Column:
    """Checks of the expected items ``e``; both as ``_plain_codes`` gives them, ``e`` with what is accepted."""

    def fits(x: Column, i: Column) -> Column:
        same = i["plain"] == x["plain"]
        if synonyms:
            same = same | F.array_contains(x["others"], i["plain"])
        if primary:
            same = same & (~x["primary"] | i["primary"])
        return F.coalesce(same, F.lit(False))

    return F.transform(e, lambda x: F.struct(F.concat(F.lit(prefix), x["key"]).alias("field_key"), F.coalesce(F.exists(g, lambda i: fits(x, i)), F.lit(False)).alias("correct")))


def score_codes(truth: DataFrame, got: DataFrame, key: str, items: str, code: str, primary: str | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(pack, field_key, correct): an item with the same code, or an accepted synonym, is there.

    With ``primary``, an expected primary item has to be marked primary too."""
    e, g = _plain_codes(F.col(items), code, primary, synonyms).alias("e"), _plain_codes(F.col(items), code, primary).alias("g")
    return _told(truth.select(key, e).join(got.select(key, g), key, "left"), [key], _code_checks(F.col("e"), F.col("g"), primary, synonyms))


def score_fields(
    truth: DataFrame, got: DataFrame, superseded: DataFrame, scalars: dict[str, str], codes: dict[str, tuple[str, str | None, dict[str, list[str]] | None]], key: str = "pack_id", invoices: str = "invoices."
) -> DataFrame:
    """(pack, field_key, correct) over all groups: scalars by kind, coded items, invoices and that none is superseded.

    ``codes`` names arrays of structs: (code field, primary field or None, accepted synonyms or None). An array's keys
    are ``items.code``, as in ``diagnoses.J18``; ``truth`` and ``got`` have a row per pack. They meet once, whatever the number of
    groups, so neither is made again for each; plain numbers and codes of ``got`` are made once a pack."""
    named = F.struct(*scalars, *codes, "invoices")
    joined = truth.select(key, named.alias("e")).join(got.select(key, named.alias("g")), key, "left").join(_old_numbers(superseded, key), key, "left")
    made = {"ei": _plain_invoices(F.col("e.invoices")), "gi": F.coalesce(_plain_invoices(F.col("g.invoices")), F.array())}
    arrays = [_scalar_checks(scalars, "e", "g")] if scalars else []
    for n, (items, (code, primary, synonyms)) in enumerate(codes.items()):
        made |= {f"e{n}": _plain_codes(F.col(f"e.{items}"), code, primary, synonyms), f"g{n}": _plain_codes(F.col(f"g.{items}"), code, primary)}
        arrays.append(_code_checks(F.col(f"e{n}"), F.col(f"g{n}"), primary, synonyms, f"{items}."))
    return _told(joined.withColumns(made), [key], *arrays, *_invoice_checks(F.col("ei"), F.col("gi"), F.col("old"), invoices))


def supersessions(pages: DataFrame) -> DataFrame:
    """(pack_id, invoice_number, replaced_by) from sentences of the form "Invoice A replaces B"."""
    found = F.regexp_extract_all("text", F.lit(r"Invoice \S+ replaces \S+"), F.lit(0))
    rows = pages.select("pack_id", F.explode(found).alias("s"))
    return rows.select("pack_id", F.regexp_replace(F.regexp_extract("s", r"replaces (\S+)", 1), r"[.,;]$", "").alias("invoice_number"), F.regexp_extract("s", r"Invoice (\S+) replaces", 1).alias("replaced_by")).distinct()


#: Rows of invoices that one task counts.
TASK_INVOICES = 1_000_000


def current_invoice_totals(invoices: DataFrame, superseded: DataFrame, approved: DataFrame, key: str = "pack_id") -> DataFrame:
    """(pack, n_invoices, total, exceeds): invoices once each and without superseded ones, against the approved amount.

    Invoices and superseded numbers are dealt by pack once, to as many tasks as their rows need, so a task holds no more when they are
    more; a number's group knows whether it is superseded, so nothing is sorted for a join."""
    rows = invoices.select(key, "invoice_number", "amount", F.lit(False).alias("old"))
    # As in a join, a missing key or number supersedes nothing.
    gone = superseded.where(F.col(key).isNotNull() & F.col("invoice_number").isNotNull()).select(key, "invoice_number", F.lit(True).alias("old"))
    parts = max(int(invoices.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-invoices.count() // TASK_INVOICES))
    dealt = rows.unionByName(gone, allowMissingColumns=True).repartition(parts, key)
    # Of rows with one number the smallest amount counts, so the choice does not hang on row order.
    current = dealt.groupBy(key, "invoice_number").agg(F.min("amount").alias("amount"), F.max("old").alias("old")).where(~F.col("old"))
    sums = current.groupBy(key).agg(F.count("*").alias("n_invoices"), F.round(F.sum("amount").cast("double"), 2).alias("total"))
    return sums.join(approved, key).select(key, "n_invoices", "total", (F.col("total") > F.col("approved_amount")).alias("exceeds"))


def fact_checks(contexts: DataFrame, questions: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Facts of each question that stand in its context, and whether it can be answered there.

    ``contexts`` has keys, text and within; ``questions`` has keys and must_contain. A context over its budget cannot be
    sent, so its text may be null: then no facts are told and nothing is answerable."""
    return judged(contexts.join(questions, list(keys)))


def judged(rows: DataFrame) -> DataFrame:
    """``fact_checks`` of rows that have their text, within and must_contain already."""
    found = F.when(F.col("text").isNotNull(), F.size(F.filter("must_contain", lambda f: F.contains(F.col("text"), f)))).cast("long")
    rows = rows.withColumn("found", found).withColumn("needed", F.size("must_contain").cast("long"))
    present = F.when(F.col("text").isNull(), None).when(F.col("needed") > 0, F.col("found") / F.col("needed")).otherwise(1.0)
    answerable = F.coalesce(F.col("found") == F.col("needed"), F.lit(False)) & F.col("within")
    return rows.withColumn("facts_present", F.round(present, 6)).withColumn("answerable", answerable).drop("text", "must_contain")


def fact_hits(contexts: DataFrame, questions: DataFrame, keys: tuple[str, ...], context_id: tuple[str, ...], question_id: tuple[str, ...]) -> DataFrame:
    """The rows of ``fact_checks`` in which a fact is found: (*context_id, *question_id, found, needed, facts_present, answerable).

    Facts and texts meet by ``phrases_in``, so a context does not meet every question of its keys. Empty facts stand in every text
    and are counted, but give no row by themselves. Ids are unique in their table; a fact that a question repeats counts as often."""
    asked = questions.select(*keys, *question_id, "must_contain", F.size("must_contain").cast("long").alias("needed"), F.size(F.filter("must_contain", lambda f: f == "")).cast("long").alias("empty"))
    facts = written(asked.select(*keys, *question_id, "needed", "empty", F.explode("must_contain").alias("fact")).groupBy(*keys, *question_id, "needed", "empty", "fact").agg(F.count("*").alias("times")))
    texts = contexts.select(*dict.fromkeys((*keys, *context_id)), "within", "text")
    met = phrases_in(texts, facts, keys, "text", "fact").join(facts, [*keys, "fact"])
    rows = met.groupBy(*dict.fromkeys((*keys, *context_id, *question_id)), "within", "needed", "empty").agg(F.sum("times").alias("hits")).withColumn("found", F.col("hits") + F.col("empty"))
    present, answerable = F.round(F.col("found") / F.col("needed"), 6), (F.col("found") == F.col("needed")) & F.col("within")
    return rows.select(*dict.fromkeys((*context_id, *question_id)), "found", "needed", present.alias("facts_present"), answerable.alias("answerable"))


def answer_check(answers: DataFrame, questions: DataFrame, key: str = "qid") -> DataFrame:
    """(qid, right): all facts stand in the answer, case, white space and commas apart."""
    right = F.forall("must_contain", lambda f: F.contains(normalise_loose(F.col("answer")), normalise_loose(f)))
    return answers.join(questions, key).select(key, F.coalesce(right, F.lit(False)).alias("right"))


def strategy_summary(contexts: DataFrame, checks: DataFrame, budget: int, new_session: DataFrame | None = None) -> DataFrame:
    """Per strategy: requests, tokens, peak, over budget, how many questions can be answered, and how many of a new session's as ``n/m``."""
    sums = contexts.groupBy("strategy").agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("total"), F.bround(F.avg("tokens")).cast("long").alias("mean"), F.max("tokens").alias("peak"), F.count_if(F.col("tokens") > budget).alias("over"),
    )
    last = contexts.groupBy("conv_id", "strategy").agg(F.max("compactions").alias("c")).groupBy("strategy").agg(F.sum("c").alias("compactions"))
    asked = checks.groupBy("strategy").agg(F.count("*").alias("questions"), F.count_if("answerable").alias("answerable"))
    rows = sums.join(last, "strategy").join(asked, "strategy", "left").fillna(0, ["questions", "answerable"])
    rows = rows.withColumn("answerable_pct", F.when(F.col("questions") > 0, F.bround(100 * F.col("answerable") / F.col("questions"), 1)).otherwise(F.lit(0.0)))
    if new_session is None:
        return rows
    fresh = new_session.groupBy("strategy").agg(F.concat_ws("/", F.count_if("answerable").cast("string"), F.count("*").cast("string")).alias("new_session"))
    return rows.join(fresh, "strategy", "left").fillna("0/0", ["new_session"])


def question_matrix(checks: DataFrame, strategies: list[str], keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Question by strategy: ``over``, ``yes`` or ``-``. ``checks(*keys, strategy, within, answerable)``; keys may add a question's kind."""
    cell = F.when(~F.col("within"), "over").when(F.col("answerable"), "yes").otherwise("-")
    return checks.groupBy(*keys).pivot("strategy", strategies).agg(F.first(cell))
