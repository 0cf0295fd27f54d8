from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import scoring as G


@pytest.fixture(scope="module")
def claims(spark, tmp_path_factory):
    """Truth, extractions and superseded numbers of 40 packs as files."""
    r, at = random.Random(3), tmp_path_factory.mktemp("claims")
    kind = "pack_id long, total string, items array<struct<code:string,main:boolean>>, invoices array<struct<invoice_number:string,amount:double>>"

    def rows(wrong: float) -> list[tuple]:
        number = lambda: f"INV-{r.randrange(6)}"
        return [(p, str(p + (r.random() < wrong)), [(f"K{i}", i == 0) for i in range(p % 4) if r.random() >= wrong], None if p == 7 else [(number(), float(i)) for i in range(p % 5)]) for p in range(40)]

    spark.createDataFrame(rows(0), kind).write.parquet(f"{at}/truth")
    spark.createDataFrame([x for x in rows(0.3) if x[0] % 9], kind).write.parquet(f"{at}/got")
    spark.createDataFrame([(p, "inv 2") for p in range(0, 40, 3)], "pack_id long, invoice_number string").write.parquet(f"{at}/old")
    return [spark.read.parquet(f"{at}/{n}") for n in ("truth", "got", "old")]


def test_score_fields_reads_each_table_once(claims):
    scored = G.score_fields(*claims, {"total": "number"}, {"items": ("code", "main", {"K1": ["K9"]})})
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    truth, got, old = ({x["pack_id"]: x for x in df.collect()} for df in claims)
    plain = lambda s: s.lower().replace("-", "").replace(" ", "")
    want = []
    for p, t in truth.items():
        g = got.get(p)
        mine = (g and g["invoices"]) or []
        want.append((p, "total", bool(g) and g["total"] == t["total"]))
        want += [(p, f"items.{x['code']}", bool(g) and any(y["code"] in (x["code"], *(["K9"] if x["code"] == "K1" else [])) and (not x["main"] or y["main"]) for y in g["items"])) for x in t["items"]]
        want += [(p, f"invoices.{x['invoice_number']}", any(y["invoice_number"] == x["invoice_number"] and y["amount"] == x["amount"] for y in mine)) for x in t["invoices"] or []]
        want.append((p, "invoices.no_superseded", bool(mine) and not (p in old and any(plain(y["invoice_number"]) == plain(old[p]["invoice_number"]) for y in mine))))
    assert sorted(map(tuple, scored.collect())) == sorted(want)


def test_totals_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_INVOICES", 50)
    r = random.Random(4)
    rows = [(r.choice([None, *range(12)]), r.choice([None, "a", "b", "c"]), r.randrange(100)) for _ in range(500)]
    gone = [(1, "a"), (2, None), (None, "b"), (3, "c"), (3, "c"), (11, "z")]
    invoices = spark.createDataFrame(rows, "pack_id long, invoice_number string, amount long")
    approved = spark.createDataFrame([(p, 150.0) for p in range(11)], "pack_id long, approved_amount double")
    got = G.current_invoice_totals(invoices, spark.createDataFrame(gone, "pack_id long, invoice_number string"), approved)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [pack_id" in plan and ", 10" in plan and plan.count("Join ") == 1
    least: dict[tuple, int] = {}
    for p, n, a in rows:
        if (p, n) not in {g for g in gone if None not in g}:
            least[p, n] = min(a, least.get((p, n), a))
    want = []
    for p in range(11):
        mine = [a for (q, _), a in least.items() if q == p]
        if mine:
            want.append((p, len(mine), float(sum(mine)), sum(mine) > 150))
    assert sorted(map(tuple, got.collect())) == want
