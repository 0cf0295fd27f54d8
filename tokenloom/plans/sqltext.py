"""Pieces of SQL (DuckDB) that several oracles share: twins of the column functions."""

from __future__ import annotations

from ..functions.text import STOP_WORDS


def tokens(x: str) -> str:
    return (
        rf"(coalesce(list_sum(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: cast(ceil(length(w) / 4.0) as bigint))), 0)"
        rf" + len(regexp_extract_all({x}, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')))::BIGINT"
    )


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({stop}))"


def shape(x: str) -> str:
    return rf"regexp_replace(lower(trim({x}, ' ' || chr(9))), '\p{{Nd}}', '#', 'g')"


def sentences(x: str) -> str:
    split = rf"string_split(regexp_replace(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda s: trim(s, ' -•')), lambda s: length(s) >= 12)"


_B, _A = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def count(x: str, pattern: str) -> str:
    """Matches that stand alone; neighbours share their separators, so separators are doubled first."""
    return rf"len(regexp_extract_all(regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '{_B}({pattern}){_A}'))"


def weight(role: str) -> str:
    return f"(CASE {role} WHEN 'user' THEN 2.0 WHEN 'assistant' THEN 2.0 WHEN 'tool' THEN 0.3 WHEN 'summary' THEN 2.5 ELSE 1.0 END)::DOUBLE"


SIGNALS = (
    r"root  cause|decid[\p{L}\p{N}_]*|agree[\p{L}\p{N}_]*|confirm[\p{L}\p{N}_]*|found|finding|next  step|action|rollback|roll  back|must|owner|blocked|todo|open  question|resolved|affected"
)
IDENTIFIERS = r"[A-Z]{1,5}--\p{Nd}{2,}|v?\p{Nd}+\.\.\p{Nd}+(?:\.\.\p{Nd}+)?|\p{Nd}{1,3}(?:,,\p{Nd}{3})+"


def salience(role: str, s: str) -> str:
    return f"({weight(role)} * (1 + 1.5 * {count(s, IDENTIFIERS)} + 2.0 * {count(s, '(?i:' + SIGNALS + ')')}))"


def render(role: str, content: str, call: str) -> str:
    return f"(CASE WHEN {role} = 'tool' THEN '[tool result: ' || coalesce({call}, 'None') || ']' || chr(10) || {content} ELSE upper({role}) || ': ' || {content} END)"


MESSAGES = (
    "SELECT conv_id, turn AS seq, turn, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'tool' ELSE role END AS role, coalesce(text, '') AS content, "
    "CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'call-' || turn END AS tool_call FROM conversations"
)
REQUESTS = "SELECT conv_id, turn AS request_id, turn AS as_of, false AS inclusive, coalesce(text, '') AS query FROM conversations WHERE role = 'user'"
NOTES = (
    "SELECT conv_id, turn * 1000 + i AS note_seq, turn, s AS text FROM (SELECT conv_id, turn, unnest(range(0, len(ss))) AS i, unnest(ss) AS s "
    f"FROM (SELECT conv_id, turn, {sentences("coalesce(text, '')")} AS ss FROM conversations WHERE role = 'assistant'))"
)
