from __future__ import annotations

import random

from tokenloom.functions import text as T
from tokenloom.operators import retrieval as R
from pyspark.sql import functions as F


def test_trims_take_what_the_expression_takes(spark):
    odd = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    every = [chr(c) for c in range(0x3100) if chr(c) not in odd]
    texts = [odd + "a" + odd + "b" + odd, odd, "", None, "a\n", "\n\na \r\n", *(c + " x " + c for c in every[::37]), *(c + "x" + c for c in odd)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(
        T.strip(F.col("t")).alias("a"), F.regexp_replace("t", rf"^{T.SPACE}+|{T.SPACE}+$", "").alias("b"), T.rstrip(F.col("t")).alias("c"), F.regexp_replace("t", rf"{T.SPACE}+$", "").alias("d")
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)


def test_prefill_counts_no_other_documents(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, "t", r.choice([None, "", " \n\n\t", "\n\n".join("w " * r.randrange(1, 9) for _ in range(r.randrange(1, 6)))])) for i in range(300)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    for budget in (0, 11, 60, 400, 9000):
        head = R.head_documents(docs, budget)
        assert head.count() <= budget // R.WRAPPER + 1
        got, want = (R.prefill_documents(R.chunk_documents(d, 6), budget).collect() for d in (head, docs))
        assert got == want
