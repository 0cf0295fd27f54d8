"""Notes, tool-result clearing, first-in-first-out cuts and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folds import greedy_skip
from ..functions.text import render_message, salience, summary_sentences, terms, token_count
from ..sources.scratch import written

# The tags around notes; the wording of a cleared result is in ``stub``.
MEMORY_TAGS = "<memory>\n</memory>"


def note_line() -> Column:
    return F.concat(F.lit("- (turn "), F.col("turn").cast("string"), F.lit(") "), F.col("text"))


def note_candidates(asked: DataFrame, lined: DataFrame) -> DataFrame:
    """(conv_id, request_id, shared, turn, note_seq, cost): the notes that a request can take, by how many of its terms they share.

    ``asked(conv_id, request_id, as_of, inclusive, qt, room)``, ``lined(conv_id, note_seq, turn, nt, cost)``. Notes with a term of the
    request are found by that term. Of notes that share equally much and cost the same, the newest are taken first, and once one does not
    fit no other does, so only the newest room / cost of each cost count. Notes without a common term are therefore looked up
    by their place among the session's notes of their cost: the work of a request does not grow with the session but for shared terms."""
    at = ["conv_id", "request_id"]
    fits = F.floor(F.col("room") / F.col("cost"))
    seen = F.col("as_of").isNull() | (F.col("turn") < F.col("as_of")) | (F.col("inclusive") & (F.col("turn") == F.col("as_of")))
    by_term = lined.select("conv_id", "note_seq", "turn", "cost", F.explode("nt").alias("term"))
    met = asked.select(*at, "as_of", "inclusive", "room", F.explode("qt").alias("term")).join(by_term, ["conv_id", "term"]).where(seen & (F.col("cost") <= F.col("room")))
    sharing = written(met.groupBy(*at, "room", "note_seq", "turn", "cost").agg(F.count("*").alias("shared")))
    newest = F.row_number().over(W.partitionBy(*at, "shared", "cost").orderBy(F.desc("turn"), "note_seq"))
    columns = [*at, "shared", "turn", "note_seq", "cost"]
    kept = sharing.withColumn("r", newest).where(F.col("r") <= fits).select(*columns)
    # Notes and requests of a session on one time line for each cost: how many notes there are up to each.
    costs = lined.groupBy("conv_id", "cost").agg(F.count("*").alias("same"))
    wanted = asked.join(costs, "conv_id").where(F.col("cost") <= F.col("room"))
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kinds = dict(asked.dtypes) | dict(lined.dtypes)
    events = lined.select("conv_id", "cost", F.col("turn").cast("long").alias("turn"), F.lit(1).alias("kind"), "note_seq", no(kinds["request_id"], "request_id"), no("long", "room")).unionByName(
        wanted.select("conv_id", "cost", F.coalesce(F.col("as_of").cast("long"), F.lit(2**62)).alias("turn"), F.when(F.col("inclusive"), 2).otherwise(0).alias("kind"), no(kinds["note_seq"], "note_seq"), "request_id", "room")
    )
    line = W.partitionBy("conv_id", "cost").orderBy("turn", "kind", F.desc("note_seq")).rowsBetween(W.unboundedPreceding, 0)
    events = written(events.withColumn("place", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(line)))
    taken = sharing.groupBy(*at, "cost").agg(F.count("*").alias("taken"))
    looking = events.where("kind <> 1 and place > 0").join(taken, [*at, "cost"], "left").withColumn("low", F.greatest(F.lit(1), F.col("place") - fits - F.coalesce("taken", F.lit(0)) + 1))
    looking = looking.select(*at, "cost", F.explode(F.sequence("low", "place")).alias("place"))
    placed = events.where("kind = 1").select("conv_id", "cost", "place", F.col("turn").cast(kinds["turn"]).alias("turn"), "note_seq")
    others = looking.join(placed, ["conv_id", "cost", "place"]).join(sharing.select(*at, "note_seq"), [*at, "note_seq"], "left_anti")
    return kept.unionByName(others.select(*at, F.lit(0).cast("long").alias("shared"), "turn", "note_seq", "cost"))


def select_notes(requests: DataFrame, notes: DataFrame, budget: int | Column = 500) -> DataFrame:
    """(conv_id, request_id, n_notes, memory): notes by shared terms, then turn, while they fit.

    ``requests(conv_id, request_id, as_of, inclusive, query)``, ``notes(conv_id, note_seq, turn, text)``.
    A request sees notes of turns before ``as_of``, or up to it when inclusive; a null ``as_of`` sees all. The
    budget is one for all, or a column of ``requests``. What is ranked for a request is bounded, see ``note_candidates``."""
    at = ["conv_id", "request_id"]
    lined = notes.select("conv_id", "note_seq", "turn", note_line().alias("line"), F.array_distinct(terms(F.col("text"))).alias("nt"))
    lined = written(lined.withColumn("cost", token_count(F.col("line")) + 1))
    start = token_count(F.lit(MEMORY_TAGS))
    room = (F.lit(budget) if isinstance(budget, int) else budget).cast("long") - start
    asked = written(requests.select(*at, "as_of", "inclusive", F.array_distinct(terms(F.col("query"))).alias("qt"), room.alias("room")))
    found = note_candidates(asked, lined).join(asked.select(*at, "room"), at)
    ranked = found.groupBy(*at, "room").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("shared"), (-F.col("turn")).alias("back"), "note_seq", "cost"))).alias("ranked"))
    kept = ranked.select(*at, F.explode(greedy_skip(F.col("ranked"), lambda x: x["cost"], F.col("room"), F.lit(0))).alias("k")).select(*at, "k.note_seq")
    lines = kept.join(lined.select("conv_id", "note_seq", "turn", "line"), ["conv_id", "note_seq"])
    shown = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    body = F.concat(F.lit("<memory>\n"), F.array_join(shown, "\n"), F.lit("\n</memory>"))
    chosen = lines.groupBy(*at).agg(F.count("*").alias("n_notes"), body.alias("memory"))
    return asked.select(*at).join(chosen, at, "left").select(*at, F.coalesce("n_notes", F.lit(0)).cast("long").alias("n_notes"), F.coalesce("memory", F.lit("")).alias("memory"))


def stub(content: Column, tool_call: Column) -> Column:
    # Fixed value: what stands in place of a cleared result.
    return F.concat(
        F.lit("[cleared "), token_count(content).cast("string"), F.lit("-token result of "), F.coalesce(tool_call, F.lit("None")),
        F.lit("; key findings are in the assistant reply that followed. Re-run the tool if raw output is needed.]"),
    )


def clear_tool_results(messages: DataFrame, keep_recent: int = 2) -> DataFrame:
    """All but each session's last ``keep_recent`` tool messages become stubs; adds ``cleared``."""
    is_tool = F.col("role") == "tool"
    later = F.row_number().over(W.partitionBy("conv_id", "is_tool").orderBy(F.desc("seq")))
    marked = messages.withColumn("is_tool", is_tool).withColumn("cleared", F.col("is_tool") & (later > keep_recent))
    return marked.withColumn("content", F.when(F.col("cleared"), stub(F.col("content"), F.col("tool_call"))).otherwise(F.col("content"))).drop("is_tool")


def rendered_tokens(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tokens", token_count(render_message(F.col("role"), F.col("content"), F.col("tool_call"))))


def fifo_fit(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of each session whose rendered total is within the budget."""
    rest = F.sum("tokens").over(W.partitionBy("conv_id").orderBy("seq").rowsBetween(0, W.unboundedFollowing))
    return rendered_tokens(messages).withColumn("rest", rest).where(F.col("rest") <= budget)


def scored_sentences(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, i, sentence, score, cost) of messages that are not cleared."""
    live = messages.where(~F.startswith("content", F.lit("[cleared")))
    rows = live.select("conv_id", "seq", "role", F.posexplode(summary_sentences(F.col("content"))).alias("i", "sentence"))
    return rows.select("conv_id", "seq", "i", "sentence", salience(F.col("role"), F.col("sentence")).alias("score"), (token_count(F.col("sentence")) + 2).alias("cost"))


def extractive_summary(messages: DataFrame, budget: int = 600) -> DataFrame:
    """(conv_id, n_sentences, summary): the most salient distinct sentences that fit, in order.

    Only the first of equal sentences counts: a later one costs the same, has no higher place
    if its score is lower, and is seen or does not fit either way."""
    place = W.partitionBy("conv_id", F.lower("sentence")).orderBy(F.desc("score"), "seq", "i")
    first = scored_sentences(messages).withColumn("r", F.row_number().over(place)).where("r = 1").where(F.col("cost") <= budget)
    lists = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "seq", "i", "sentence", "cost"))).alias("ranked"))
    kept = lists.withColumn("kept", greedy_skip(F.col("ranked"), lambda x: x["cost"], F.lit(budget), F.lit(0)))
    shown = F.array_sort(F.transform("kept", lambda x: F.struct(x["seq"].alias("seq"), x["i"].alias("i"), x["sentence"].alias("sentence"))))
    summary = F.array_join(F.transform(shown, lambda x: F.concat(F.lit("- "), x["sentence"])), "\n")
    return messages.select("conv_id").distinct().join(kept.select("conv_id", F.size("kept").cast("long").alias("n_sentences"), summary.alias("summary")), "conv_id", "left").select(
        "conv_id", F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"), F.coalesce("summary", F.lit("")).alias("summary")
    )
