"""Packing reads only what can be taken, and searching shuffles only what is near the best."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tokenloom.operators import retrieval as R


def test_pack_chunks_lists_stay_short(spark, monkeypatch):
    """A query near thousands of chunks of a few sizes once made a list of all of them."""
    rng = random.Random(3)
    rows = [("q", i, 0, 9.0 - i / 1000, i + 1, rng.choice([30, 50, 80])) for i in range(900)]
    ranked = spark.createDataFrame([r[:5] for r in rows], "query_id string, doc_id long, chunk_no long, score double, rank long")
    chunks = spark.createDataFrame([(r[1], r[2], r[5]) for r in rows], "doc_id long, chunk_no long, tokens long")
    seen = []
    monkeypatch.setattr(R, "greedy_skip", lambda ranked, *rest, of=R.greedy_skip: (seen.append(ranked), of(F.when(F.size(ranked) <= 12, ranked), *rest))[1])
    want, room = [], 200
    for r in rows:
        if len(want) < 4 and r[5] + R.WRAPPER <= room:
            want.append((r[1], r[5]))
            room -= r[5] + R.WRAPPER
    got = R.pack_chunks(ranked, chunks, 200).orderBy("pick").collect()
    assert seen and [(r.doc_id, r.tokens) for r in got] == want


def test_near_in_many_rounds(spark, monkeypatch):
    """Rounds, small places and the matrix of frequent terms give what the whole search gives."""
    rng = random.Random(5)
    text = lambda n: " ".join(f"t{min(int(rng.expovariate(0.2)), 40)}" for _ in range(n))
    chunks = spark.createDataFrame([(i, 0, "x", text(rng.randrange(1, 40))) for i in range(300)], "doc_id long, chunk_no long, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", text(rng.randrange(1, 9))) for i in range(60)], "query_id string, text string")
    full = R.bm25_search(queries, chunks).collect()
    top = {}
    for r in full:
        top[r.query_id] = max(top.get(r.query_id, 0), r.score)
    want = sorted(tuple(r) for r in full if top[r.query_id] >= 1 and r.score >= round(top[r.query_id] * 0.8, 6))
    for queries_a_round, places, dense in ((7, 50, 0), (1000, 1000, 5), (25, 4_000_000, 256)):
        monkeypatch.setattr(R, "ROUND_QUERIES", queries_a_round)
        monkeypatch.setattr(R, "PLACES", places)
        monkeypatch.setattr(R, "DENSE", dense)
        assert sorted(map(tuple, R.bm25_near(queries, chunks, 0.8, 1.0).collect())) == want
