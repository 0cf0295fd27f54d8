"""Which of many phrases stand in which texts, each text read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small, written

#: Phrases of so many characters in all go to every task as one automaton; beyond, phrases and texts meet on rare tokens.
AUTOMATON_CHARS = 20_000_000
GRAM = 3


def _automaton(phrases: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        made.add_word(p, i)
    made.make_automaton()
    return made


def phrases_in(texts: DataFrame, phrases: DataFrame, by: tuple[str, ...] = (), text: str = "text", phrase: str = "phrase") -> DataFrame:
    """The rows of ``texts`` with each phrase that stands in their text, as plain characters; the text itself is left out.

    ``phrases(*by, phrase)``: a phrase counts for texts with its ``by`` columns. Empty phrases and null texts are not found. All phrases make one
    automaton that reads every text once, if they are small enough to be sent to every task, else see ``by_rarest_token``."""
    listed = written(phrases.select(*by, phrase).where(F.col(phrase) != "").distinct())
    if (listed.agg(F.sum(F.char_length(phrase))).first()[0] or 0) > AUTOMATON_CHARS:
        return by_rarest_token(texts, listed, by, text, phrase)
    known = [r[0] for r in listed.select(phrase).distinct().collect()]
    rest = [c for c in texts.columns if c != text]
    if not known:
        return texts.select(*rest, F.lit("").alias(phrase)).limit(0)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held = None, sent.value
        for batch in batches:
            automaton = automaton or _automaton(held)
            rows, found = [], []
            for i, t in enumerate(batch.column(len(rest)).to_pylist()):
                if t:
                    mine = {k for _, k in automaton.iter(t)}
                    rows += [i] * len(mine)
                    found += [held[k] for k in mine]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(rest)], pa.array(found, pa.string())], [*rest, phrase])

    kinds = dict(texts.dtypes)
    met = texts.select(*rest, text).mapInArrow(read, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{phrase}` string"]))
    return met.join(small(listed), [*by, phrase], "left_semi").select(*rest, phrase) if by else met


def _grams(text: Column, k: int = GRAM) -> Column:
    """All runs of ``k`` characters."""
    n = F.char_length(text)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def _inner(phrase: Column) -> Column:
    """Words that a text with the phrase holds between blanks: all but the first and last."""
    words = F.split(phrase, " ")
    return F.when(F.size(words) >= 3, F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1))), lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def anchors(texts: DataFrame, listed: DataFrame, by: tuple[str, ...], text: str, phrase: str) -> tuple[DataFrame, DataFrame]:
    """(row, *by, token) of texts and (*by, token, phrase): each phrase with the one of its tokens that stands in fewest texts.

    Tokens are inner words, or runs of three characters where a phrase has none, or the phrase itself where it is shorter. Phrases
    with a token that no text has are left out: they stand nowhere."""
    short = F.char_length(phrase) < GRAM
    words = F.transform(_inner(F.col(phrase)), lambda w: F.concat(F.lit("w"), w))
    grams = F.transform(F.when(short, F.array(phrase)).otherwise(_grams(F.col(phrase))), lambda g: F.concat(F.lit("g"), g))
    tokens = written(listed.select(*by, phrase, F.explode(F.array_distinct(F.when(F.size(words) > 0, words).otherwise(grams))).alias("token")))
    kinds = tokens.agg(F.bool_or(F.startswith("token", F.lit("g"))).alias("g"), F.min(F.when(F.startswith("token", F.lit("g")), F.char_length("token"))).alias("least")).first()
    held = [F.transform(F.split(text, " "), lambda w: F.concat(F.lit("w"), w))]
    if kinds["g"]:
        held += [F.transform(_grams(F.col(text), k), lambda g: F.concat(F.lit("g"), g)) for k in range(kinds["least"] - 1, GRAM + 1)]
    at = [*by, "token"]
    wanted = written(tokens.select(*at).distinct())
    places = written(texts.select("row", *by, F.explode(F.array_distinct(F.concat(*held))).alias("token")).join(small(wanted), at, "left_semi"))
    counted = places.groupBy(*at).agg(F.count("*").alias("df"))
    whole = tokens.groupBy(*by, phrase).agg(F.count("*").alias("of"))
    seen = tokens.join(counted, at).groupBy(*by, phrase).agg(F.count("*").alias("n"), F.min_by("token", F.struct("df", "token")).alias("token"))
    return places, seen.join(whole, [*by, phrase]).where("n = of").select(*at, phrase)


def by_rarest_token(texts: DataFrame, listed: DataFrame, by: tuple[str, ...], text: str, phrase: str) -> DataFrame:
    """``phrases_in`` for phrases of any number: a phrase meets the texts that hold its rarest token, by counts, and is looked for there."""
    rest = [c for c in texts.columns if c != text]
    texts = written(texts.where(F.col(text).isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    places, anchored = anchors(texts, listed, by, text, phrase)
    met = places.join(written(anchored), [*by, "token"]).select("row", phrase)
    # Texts are read again for the pairs that meet, not carried with every token.
    return met.join(texts, "row").where(F.contains(text, phrase)).select(*rest, phrase)
