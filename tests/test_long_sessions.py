"""Notes and context texts of long sessions: equal to plain versions, with bounded work."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.text import STOP_WORDS, terms, token_count
from tokenloom.operators import history as H
from tokenloom.operators import sessions as Z


def made(seed: int, turns: int, vocabulary: int):
    rng = random.Random(seed)
    notes, requests = [], []
    for conv in ("a", "b"):
        for turn in range(turns):
            for i in range(rng.randrange(0, 3)):
                notes.append((conv, turn * 10 + i, turn, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 30)))))
        for r in range(12):
            as_of = None if r == 0 else rng.randrange(turns + 2)
            requests.append((conv, r, as_of, bool(r % 2), " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 6)))))
    requests.append(("nobody", 0, 3, False, "w1"))
    return notes, requests


def plain_notes(notes, request, budget):
    conv, _, as_of, inclusive, query = request
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if w not in STOP_WORDS}
    used = Z._heuristic(H.MEMORY_TAGS)
    found = []
    for of, seq, turn, text in notes:
        if of == conv and (as_of is None or turn < as_of or inclusive and turn == as_of):
            line = f"- (turn {turn}) {text}"
            found.append((-len(words(text) & words(query)), -turn, seq, turn, line, Z._heuristic(line) + 1))
    kept = []
    for _, _, _, turn, line, cost in sorted(found):
        if used + cost <= budget:
            used += cost
            kept.append((turn, line))
    return len(kept), "<memory>\n" + "\n".join(x for _, x in sorted(kept)) + "\n</memory>" if kept else ""


@pytest.mark.parametrize("seed, turns, vocabulary, budget", [(1, 40, 30, 100), (2, 150, 500, 60), (3, 25, 5, 300), (4, 60, 40, 9)])
def test_select_notes_brute_force(spark, seed, turns, vocabulary, budget):
    notes, requests = made(seed, turns, vocabulary)
    asked = spark.createDataFrame(requests, "conv_id string, request_id int, as_of int, inclusive boolean, query string")
    told = spark.createDataFrame(notes, "conv_id string, note_seq int, turn int, text string")
    got = {(r["conv_id"], r["request_id"]): (r["n_notes"], r["memory"]) for r in H.select_notes(asked, told, budget).collect()}
    assert got == {(r[0], r[1]): plain_notes(notes, r, budget) for r in requests}
    none = H.select_notes(asked, told.limit(0), budget).collect()
    assert len(none) == len(requests) and all(r["n_notes"] == 0 and r["memory"] == "" for r in none)


def test_notes_of_a_long_session_are_not_all_met(spark):
    """10,000 turns with a note each: a request ranks those that share a term and some of each cost, whatever its turn."""
    notes = spark.range(10_000).select(F.lit("s").alias("conv_id"), F.col("id").alias("note_seq"), F.col("id").alias("turn"), F.concat(F.lit("note t"), F.col("id"), F.lit(" alpha beta gamma")).alias("text"))
    asked = spark.range(0, 10_000, 50).select(F.lit("s").alias("conv_id"), F.col("id").alias("request_id"), F.col("id").alias("as_of"), F.lit(False).alias("inclusive"), F.concat(F.lit("t"), F.col("id") - 7, F.lit(" t5")).alias("query"))
    lined = notes.select("conv_id", "note_seq", "turn", F.array_distinct(terms(F.col("text"))).alias("nt"), (token_count(F.col("text")) + 1).alias("cost"))
    ready = asked.select("conv_id", "request_id", "as_of", "inclusive", F.array_distinct(terms(F.col("query"))).alias("qt"), F.lit(200).cast("long").alias("room"))
    rows = H.note_candidates(ready, lined).groupBy("request_id").agg(F.count("*").alias("n"), F.count_if(F.col("shared") > 0).alias("shared")).collect()
    assert max(r["n"] for r in rows) <= 2 + 3 * (200 // 7 + 2) and {r["shared"] for r in rows if r["request_id"] >= 50} == {2}
