"""Incremental session compaction on a stream of messages: the batch replay's state, kept per session."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import Plan, Session, counted_messages, visible

OUTPUT = "conv_id long, seq long, as_of long, history_tokens long, first_seq long, n_messages long, summary string, compactions long, late boolean"
#: A message that is not folded yet; its scored sentences as JSON.
HELD = "turn long, seq long, role string, tokens long, stub_tokens long, cleared boolean, sentences string"
COUNTERS = "summary string, upto long, compactions long, folded_turn long, folded_seq long, expires long"
STATE = "conv_id long, messages string, counters string"
_NAMES, _ROW = ([c.split()[0] for c in x.split(", ")] for x in (HELD, OUTPUT))
#: Stands in the place of a folded message, so that positions stay.
_GONE = {"role": "", "tokens": 0, "stub_tokens": 0, "cleared": False, "sentences": [], "turn": -1, "seq": -1}


@dataclass
class Kept:
    """A session between batches: its messages from the fold point on, the summary and the counters."""

    messages: list[dict] = field(default_factory=list)
    summary: list[dict] = field(default_factory=list)
    upto: int = 0
    compactions: int = 0
    folded: tuple[int, int] | None = None

    def take(self, conv_id: int, new: list[dict], plan: Plan, clearing: bool) -> list[dict]:
        """The rows that new messages, in order, give; the state moves on.

        Each user message is a request that sees the turns before it. A message from before the fold point is
        reported as late and not folded."""
        session = Session(self.summary, self.upto, self.compactions)
        messages, out = [_GONE] * self.upto + self.messages, []
        for m in new:
            late = self.folded is not None and (m["turn"], m["seq"]) <= self.folded
            row = {"conv_id": conv_id, "seq": m["seq"], "as_of": m["turn"], "late": late}
            if late:
                out.append(row | {"history_tokens": 0, "first_seq": 0, "n_messages": 0, "summary": "", "compactions": session.compactions})
                continue
            if m["role"] == "user":
                upto = visible(np.array([x["turn"] for x in messages]), m["turn"], False)
                out.append(row | session.history(messages, upto, plan.budget, plan, clearing, True))
                if session.upto:
                    self.folded = messages[session.upto - 1]["turn"], messages[session.upto - 1]["seq"]
            messages.append(m)
        self.messages, self.summary, self.upto, self.compactions = messages[session.upto :], session.summary, session.upto, session.compactions
        return out


def _plain(x):
    return x.item()


def _told(messages: Iterable[dict]) -> list[dict]:
    """Messages in order, as plain values."""
    rows = []
    for m in sorted(messages, key=lambda m: (m["turn"], m["seq"])):
        sentences = [dict(s.asDict() if hasattr(s, "asDict") else s) for s in m["sentences"]]
        rows.append({"turn": int(m["turn"]), "seq": int(m["seq"]), "role": m["role"], "tokens": int(m["tokens"]), "stub_tokens": int(m["stub_tokens"]), "cleared": bool(m["cleared"]), "sentences": sentences})
    return rows


class Compaction(StatefulProcessor):
    """A list of messages and one row of counters per session.

    New messages are appended; the list is only written anew when a fold has shortened it. Within a micro-batch messages are taken by
    (turn, seq). With ``idle_ms`` a timer ends a session that has had no message for so long: what comes later begins a new one."""

    def __init__(self, plan: Plan, clearing: bool, idle_ms: int | None = None):
        self.plan, self.clearing, self.idle_ms = plan, clearing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("messages", HELD)
        self.counters = handle.getValueState("counters", COUNTERS)

    def _load(self) -> tuple[Kept, int | None]:
        if not self.counters.exists():
            return Kept(), None
        summary, upto, compactions, turn, seq, expires = self.counters.get()
        messages = [dict(zip(_NAMES, row, strict=True)) for row in self.held.get()] if self.held.exists() else []
        for m in messages:
            m["sentences"] = json.loads(m["sentences"])
        return Kept(messages, json.loads(summary), upto, compactions, None if turn is None else (turn, seq)), expires

    def _store(self, kept: Kept, appended: list[dict] | None, expires: int | None) -> None:
        """``appended``: the messages that are new, or None if the whole list has to be written."""
        rows = [tuple(json.dumps(m[c], default=_plain) if c == "sentences" else m[c] for c in _NAMES) for m in (kept.messages if appended is None else appended)]
        if appended is None and rows:
            self.held.put(rows)
        elif appended is None:
            self.held.clear()
        elif rows:
            self.held.appendList(rows)
        turn, seq = kept.folded or (None, None)
        self.counters.update((json.dumps(kept.summary, default=_plain), kept.upto, kept.compactions, turn, seq, expires))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept, expires = self._load()
        before, held = kept.upto, len(kept.messages)
        out = kept.take(int(key[0]), _told(r.asDict() for r in rows), self.plan, self.clearing)
        if self.idle_ms is not None:
            if expires is not None:
                self.handle.deleteTimer(expires)
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(expires)
        self._store(kept, kept.messages[held:] if kept.upto == before else None, expires)
        yield from (Row(**{c: x[c] for c in _ROW}) for x in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        self.counters.clear()
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        row = initialState
        counters = json.loads(row["counters"])
        kept = Kept(json.loads(row["messages"]), counters["summary"], counters["upto"], counters["compactions"], tuple(counters["folded"]) if counters["folded"] else None)
        self._store(kept, None, None)

    def close(self) -> None:
        pass


def session_states(messages: DataFrame, plan: Plan, clearing: bool = True) -> DataFrame:
    """(conv_id, messages, counters): where each session stands after these messages, for a stream to go on from."""

    def last(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kept = Kept()
        kept.take(int(key[0]), _told(frame.to_dict("records")), plan, clearing)
        state = asdict(kept)
        return pd.DataFrame({"conv_id": [key[0]], "messages": [json.dumps(state.pop("messages"), default=_plain)], "counters": [json.dumps(state, default=_plain)]})

    return counted_messages(messages).groupBy("conv_id").applyInPandas(last, STATE)


def compact_stream(messages: DataFrame, plan: Plan, clearing: bool = True, idle_ms: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """A streaming DataFrame of one row per user message, equal to the batch replay of the session.

    ``state`` is what ``session_states`` gave for earlier messages; ``idle_ms`` ends sessions without messages. The state store has to be RocksDB's."""
    return counted_messages(messages).groupBy("conv_id").transformWithState(
        statefulProcessor=Compaction(plan, clearing, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
        initialState=None if state is None else state.groupBy("conv_id"),
    )
