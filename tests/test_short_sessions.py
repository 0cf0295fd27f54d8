from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from tokenloom.operators import sessions as Z
from tokenloom.streaming.compaction import OUTPUT, Compaction

PLAN = Z.Plan(window=400, reserve=100, keep_messages=2, keep_tools=1, summary=60)


def test_many_short_sessions_share_a_frame(spark):
    """Sessions are replayed from rows in batches; one without an id, without messages or before its first message is replayed as well."""
    told = [(c, i, i, "user" if i % 2 == 0 else "assistant", f"Finding {c}.{i} of T-10{i} is confirmed by the owner. " * 6, None) for c in [*range(150), None] for i in range(6)]
    messages = spark.createDataFrame(told, "conv_id long, seq long, turn long, role string, content string, tool_call string")
    asked = messages.where("role = 'user'").select("conv_id", F.col("turn").alias("request_id"), F.col("turn").alias("as_of"), F.lit(False).alias("inclusive"))
    asked = asked.unionByName(spark.createDataFrame([(900, 3, 3, False)], asked.schema))
    got = Z.compact_sessions(messages, asked, PLAN)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    rows = {(r["conv_id"], r["request_id"]): r for r in got.collect()}
    assert len(rows) == 151 * 3 + 1 and rows[900, 3]["n_messages"] == 0 and rows[0, 0]["n_messages"] == 0
    alike = lambda r: (r["first_seq"], r["n_messages"], r["compactions"])
    assert alike(rows[None, 4]) == alike(rows[5, 4]) and rows[None, 4]["first_seq"] + rows[None, 4]["n_messages"] == 4
    assert rows[None, 4]["compactions"] > 0 and "Finding None" not in rows[5, 4]["summary"]


def test_marks_are_looked_for_once_a_sentence(spark):
    messages = spark.createDataFrame([(1, 0, 0, "tool", "The root cause was T-1000, found today.", "x")], "conv_id long, seq long, turn long, role string, content string, tool_call string")
    counted = Z.counted_messages(messages)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("root cause") == 1
    s = counted.first()["sentences"][0]
    assert (s["score"], s["summary_score"]) == (0.3 * 6.5, 2.5 * 6.5)


class _Held:
    """A state variable without a store."""

    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = put = lambda self, value: setattr(self, "value", value)
    appendList = lambda self, rows: setattr(self, "value", [*(self.value or []), *rows])


def test_stream_takes_and_gives_rows():
    """No frame is made for a session of a few messages."""
    sentence = Row(text="Finding T-101 is confirmed", score=9.0, summary_score=9.0, cost=8)
    told = [Row(conv_id=1, seq=i, turn=i, role="user", tokens=90, stub_tokens=9, cleared=False, sentences=[sentence]) for i in (1, 0, 3, 2)]
    made = Compaction(PLAN, True)
    made.held, made.counters = _Held(), _Held()
    out = [r for part in (told[:2], told[2:]) for r in made.handleInputRows((1,), iter(part), None)]
    assert all(isinstance(r, Row) and list(r.asDict()) == [c.split()[0] for c in OUTPUT.split(", ")] for r in out)
    assert [(r["seq"], r["first_seq"] + r["n_messages"]) for r in out] == [(0, 0), (1, 1), (2, 2), (3, 3)]
