"""Sums and bins by blocks, and searches by bounds, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.folds import next_fit_bounds
from tokenloom.functions.scan import next_fit_bins, sums_before
from tokenloom.operators import pages as P
from tokenloom.operators import retrieval as R


def lists(seed: int) -> dict[str, list[int]]:
    rng = random.Random(seed)
    return {"long": [rng.choice([0, 1, 5, 30, 200]) for _ in range(900)], "short": [7], "zeros": [0] * 40, "wide": [500, 1, 500, 500, 0, 0, 3], **{f"k{i}": [rng.randrange(60) for _ in range(rng.randrange(1, 30))] for i in range(12)}}


def frame(spark, held):
    rows = [(k, i, v) for k, values in held.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v long").repartition(7)


def test_sums_before(spark):
    held = lists(1)
    got = {(r["k"], r["i"]): (r["at"], r["before"]) for r in sums_before(frame(spark, held).withColumn("one", F.lit(1)), ["k"], ["i"], {"at": "one", "before": "v"}).collect()}
    assert got == {(k, i): (i, sum(values[:i])) for k, values in held.items() for i in range(len(values))}
    assert sums_before(frame(spark, {}), ["k"], ["i"], {"before": "v"}).count() == 0


@pytest.mark.parametrize("seed, cap, walk", [(1, 100, 4096), (2, 100, 8), (3, 31, 5), (4, 450, 3)])
def test_next_fit_bins(spark, seed, cap, walk):
    held = lists(seed)
    got = sorted((r["k"], r["first"], r["n"], r["tokens"]) for r in next_fit_bins(frame(spark, held).withColumn("cap", F.lit(cap)), ["k"], ["i"], "v", "cap", walk).collect())
    assert got == sorted((k, b["first"], b["n"], b["tokens"]) for k, values in held.items() for b in next_fit_bounds(np.array(values), cap))


def test_boilerplate_sentences_over_many_pages(spark):
    """Sentences that run over pages are those of the pack's text read at once."""
    import re

    rng = random.Random(3)
    made = {}
    for pack in "ab":
        for page in range(60):
            parts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 15))) + rng.choice([".", "!", "", "", " 7. x"]) for _ in range(rng.randrange(0, 4))]
            made[pack, page] = rng.choice([" ", "\n"]).join(parts)
    pages = spark.createDataFrame([(k, n, t, "terms") for (k, n), t in made.items()], "pack_id string, page_no int, text string, kind string").repartition(6)
    want = set()
    for pack in "ab":
        flat = re.sub(r"\s+", " ", " ".join(made[pack, n] for n in range(60)))
        # Numbers are taken away page by page, as a page's end is a blank.
        flat = re.sub(r"\b\d+\.\s", "", flat)
        want |= {(pack, s.strip()) for s in re.split(r"(?<=[.!?])\s+", flat) if len(s.strip()) > 40}
    got = {(r["pack_id"], re.sub(" +", " ", r["sentence"])) for r in P.boilerplate_sentences(pages).collect()}
    assert got == {(p, re.sub(" +", " ", s)) for p, s in want}


@pytest.mark.parametrize("relative, least", [(0.6, 2.0), (0.9, 0.5), (0.2, 0.0), (1.0, 4.0)])
def test_bounded_search_is_the_full_one(spark, relative, least):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, "c", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(400)]
    chunks = spark.createDataFrame(docs, "doc_id long, title string, text string").withColumn("chunk_no", F.lit(0))
    queries = spark.createDataFrame([(q, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for q in range(40)] + [(90, "nothing"), (91, ""), (92, None)], "query_id long, text string")
    full = R.bm25_search(queries, chunks).collect()
    top: dict = {}
    for r in full:
        top[r["query_id"]] = max(top.get(r["query_id"], 0), r["score"])
    want = sorted(tuple(r) for r in full if top[r["query_id"]] >= least and r["score"] >= round(top[r["query_id"]] * relative, 6))
    assert sorted(map(tuple, R.bm25_near(queries, chunks, relative, least).collect())) == want
    # Only a part of the chunks that share a term is scored whole.
    if relative >= 0.6:
        postings, weighed = R._weighed(queries, chunks, 1.4, 0.75)
        assert len(want) <= R.near_candidates(postings, weighed, relative, least).count() < 0.5 * len(full)


def made_phrases():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["aa", "ab", "ba", "b", "a\nb", "é", "aab"]) for _ in range(rng.randrange(0, 25))) for _ in range(120)]
    phrases = {t[i : i + rng.randrange(1, 14)] for t in texts for i in [rng.randrange(max(1, len(t)))]} | {"a", "aa", "a b", "a  b", "zz", "", "ab ba", "b aa b", "\n"}
    return texts, sorted(phrases)


@pytest.mark.parametrize("limit", [20_000_000, -1])
@pytest.mark.parametrize("short", [True, False])
def test_phrases_in(spark, monkeypatch, limit, short):
    """Phrases of one, two and more words, at words' edges and inside, by the automaton and by rare tokens."""
    from tokenloom.functions import phrases as H

    monkeypatch.setattr(H, "AUTOMATON_CHARS", limit)
    texts, phrases = made_phrases()
    phrases = [p for p in phrases if short or len(p) >= 3 and p.count(" ") >= 2 or not p]
    rows = [(i, "xy"[i % 2], t, "kept") for i, t in enumerate(texts)] + [(900, "x", None, ""), (901, "x", "", "")]
    of = [("x", p) for p in phrases] + [("y", p) for p in phrases[::2]]
    got = H.phrases_in(spark.createDataFrame(rows, "id int, k string, text string, more string"), spark.createDataFrame(of, "k string, phrase string"), ("k",))
    assert got.columns == ["id", "k", "more", "phrase"]
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == sorted((i, p) for i, k, t, _ in rows for q, p in of if t and p and q == k and p in t)
    bare = H.phrases_in(spark.createDataFrame(rows[:5], "id int, k string, text string, more string"), spark.createDataFrame([("",)], "phrase string"))
    assert bare.count() == 0


def test_phrases_meet_on_their_rarest_token(spark):
    from tokenloom.functions import phrases as H

    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(2000)], k=80)) for _ in range(300)]
    phrases = [" ".join(rng.choice(texts).split(" ")[3:9]) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    places, anchored = H.anchors(frame, spark.createDataFrame([(p,) for p in set(phrases)], "phrase string"), (), "text", "phrase")
    held = [set(t.split(" ")) for t in texts]
    want = sum(min(sum(w in h for h in held) for w in p.split(" ")[1:-1]) for p in set(phrases))
    assert places.join(anchored, "token").count() == want < 0.2 * len(texts) * len(set(phrases))


def test_fact_hits_are_the_checks_with_a_fact(spark):
    from tokenloom.operators import scoring as G

    texts, phrases = made_phrases()
    contexts = spark.createDataFrame([(i, "p", t, i % 3 > 0) for i, t in enumerate(texts)] + [(900, "p", None, True)], "doc_id int, pack_id string, text string, within boolean")
    rng = random.Random(5)
    questions = spark.createDataFrame([(q, "p", [p for p in rng.sample(phrases, 4) if p] + (["aa", "aa"] if q % 4 == 0 else [])) for q in range(30)], "item_id int, pack_id string, must_contain array<string>")
    want = G.fact_checks(contexts, questions, ("pack_id",)).where("found > 0").select("doc_id", "item_id", "found", "needed", "facts_present", "answerable").collect()
    assert sorted(map(tuple, G.fact_hits(contexts, questions, ("pack_id",), ("doc_id",), ("item_id",)).collect())) == sorted(map(tuple, want))
