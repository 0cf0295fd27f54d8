"""Runs of words behind a bit map, and boilerplate that is found by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.runs import RUNS, run_key, runs_held
from tokenloom.operators.pages import strip_boilerplate


def test_runs_held_lets_only_wanted_runs_through(spark):
    """All runs of a page used to be shuffled; now only those that some phrase is looked for by."""
    texts = [(i, [f"w{(i * 37 + j) % 991}" for j in range(200)]) for i in range(40)]
    pages = spark.createDataFrame([*texts, (98, []), (99, None)], "page_no long, words array<string>")
    wanted = {n: texts[7][1][50 : 50 + n] for n in RUNS}
    enough, key = run_key(F.col("ws"))
    keys = spark.createDataFrame([(n, ws) for n, ws in wanted.items()], "n long, ws array<string>").where(enough).select("n", key.alias("key"))
    found = runs_held(pages, "words", keys.select("key"))
    assert found.count() < 200 and found.distinct().count() == found.count()
    got = {(r.page_no, r.n) for r in found.join(keys, "key").select("page_no", "n").collect()}
    want = {(i, n) for i, ws in texts for n, run in wanted.items() if any(ws[j : j + n] == run for j in range(len(ws) - n + 1))}
    assert got == want


def test_sentence_that_only_a_cut_brings_together_stays(spark):
    """As in the SQL, a sentence counts if the page as it came holds it."""
    inner, outer = "The quick notice of all general terms that apply here.", "Payment is due within thirty days after receipt of an invoice by the member."
    odd = "Averyveryveryverylongword andanotherverylongword."
    head, tail = outer.split(" receipt ")
    rows = [
        (1, f"{inner} {outer} {odd}", "terms"), (2, f"Intro.\n{head} {inner}\nreceipt {tail}\nrest", "other"), (3, f"Body {inner.replace(' ', chr(10), 2)} tail\nx{outer}\n{odd}", "other"), (4, "Nothing shared.", "other"),
    ]
    pages = spark.createDataFrame([("p", n, t, k, None) for n, t, k in rows], "pack_id string, page_no long, text string, kind string, dropped_reason string")
    got = {r.page_no: r.text for r in strip_boilerplate(pages, ("terms",)).collect()}
    assert got == {1: rows[0][1], 2: f"Intro.\n{head}\nreceipt {tail}\nrest", 3: "Body  tail\nx", 4: "Nothing shared."}
