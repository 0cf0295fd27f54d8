"""Scalar text functions as column expressions; patterns spell out Unicode classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]

# Result-defining word lists, patterns and weights.
STOP_WORDS = tuple(
    "a an and are as at be by for from has have in is it its of on or that the this to was "
    "were what which with will who how does do our we you your i".split()
)
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EDGE = r"(?<![\p{L}\p{N}_])"
EDGE_AFTER = r"(?![\p{L}\p{N}_])"
IDENTIFIER = (
    rf"{EDGE}[A-Z]{{1,5}}-\p{{Nd}}{{2,}}{EDGE_AFTER}|{EDGE}v?\p{{Nd}}+\.\p{{Nd}}+(\.\p{{Nd}}+)?{EDGE_AFTER}|{EDGE}\p{{Nd}}{{1,3}}(,\p{{Nd}}{{3}})+{EDGE_AFTER}"
)
SIGNAL = (
    rf"(?i){EDGE}(root cause|decid[\p{{L}}\p{{N}}_]*|agree[\p{{L}}\p{{N}}_]*|confirm[\p{{L}}\p{{N}}_]*|found|finding|next step|action|rollback|roll back|"
    rf"must|owner|blocked|todo|open question|resolved|affected){EDGE_AFTER}"
)
ROLE_WEIGHT = {"user": 2.0, "assistant": 2.0, "tool": 0.3, "summary": 2.5}


def token_count(text: Column) -> Column:
    """A word costs a quarter of its characters, rounded up; any other visible character costs 1."""
    # One character is left of every four of a word, none of white space; what stands between counts as it is.
    left = F.regexp_replace(text, rf"{SPACE}++|([\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_]{{0,3}}+", "$1")
    return F.coalesce(F.char_length(left), F.lit(0)).cast("long")


def quarter_chars(text: Column) -> Column:
    return F.coalesce(F.ceil(F.char_length(text) / 4), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(0)).cast("long")


COUNTERS: dict[str, Counter] = {"heuristic": token_count, "chars4": quarter_chars, "words": word_count}


def terms(text: Column) -> Column:
    """Search terms in order, with repeats."""
    found = F.split(F.lower(text), "[^a-z0-9]+")
    return F.coalesce(F.filter(found, lambda t: ~t.isin("", *STOP_WORDS)), F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def strip(text: Column) -> Column:
    # Looks at a text's ends only; an expression would look for its end at every white space.
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def line_shape(line: Column) -> Column:
    return F.regexp_replace(F.lower(strip(line)), r"\p{Nd}", "#")


def normalise_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def normalise_loose(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), rf"(?:{SPACE}|,)+", "")


def summary_sentences(text: Column) -> Column:
    """Split after .!? or on line runs; blanks, dashes and bullets stripped; under 12 characters dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){SPACE}+|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, "^[ \\-•]+|[ \\-•]+$", "")), lambda s: F.char_length(s) >= 12)


def role_weight(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_WEIGHT.items() for x in kv])[role], F.lit(1.0))


def marks(sentence: Column) -> Column:
    """What identifiers and signal words make of a sentence, whoever said it."""
    return 1 + 1.5 * F.regexp_count(sentence, F.lit(IDENTIFIER)) + 2.0 * F.regexp_count(sentence, F.lit(SIGNAL))


def salience(role: Column, sentence: Column) -> Column:
    return role_weight(role) * marks(sentence)


def render_message(role: Column, content: Column, tool_call: Column) -> Column:
    call = F.coalesce(tool_call, F.lit("None"))
    return F.when(role == "tool", F.concat(F.lit("[tool result: "), call, F.lit("]\n"), content)).otherwise(F.concat(F.upper(role), F.lit(": "), content))


def render_chunk(chunk_id: Column, title: Column, text: Column) -> Column:
    return F.concat(F.lit('<document id="'), chunk_id, F.lit('" title="'), title, F.lit('">\n'), text, F.lit("\n</document>"))


def render_page(kind: Column, page_no: Column, text: Column) -> Column:
    return F.concat(F.lit('<doc type="'), kind, F.lit('" page="'), page_no.cast("string"), F.lit('">\n'), text, F.lit("\n</doc>"))


def plain_value(text: Column) -> Column:
    """Lower case, doctors' titles and all but ASCII letters and digits removed."""
    return F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit("dr "), F.lit("")), F.lit("dr."), F.lit("")), "[^a-z0-9]", "")


def lenient_number(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("HKD"), F.lit(""))).try_cast("double")


def lenient_date(text: Column) -> Column:
    value = strip(text)
    return F.coalesce(*[F.try_to_date(value, f) for f in ("yyyy-M-d", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy")])


def values_match(kind: str, expected: Column, got: Column) -> Column:
    """Formatting is forgiven, substance is not; ``got`` is text. A null matches nothing."""
    if kind == "bool":
        same = F.lower(got) == F.lower(expected.cast("string"))
    elif kind == "number":
        same = F.abs(lenient_number(got) - expected.cast("double")) < 0.01
    elif kind == "date":
        same = lenient_date(got) == expected.cast("date")
    else:
        e, g = plain_value(expected.cast("string")), plain_value(got)
        same = (g != "") & (F.contains(g, e) | F.contains(e, g))
    return F.coalesce(same, F.lit(False))


def json_body(reply: Column) -> Column:
    """The body of a ```json fence, else from the first { to the last }."""
    fenced = F.regexp_extract(reply, r"(?s)```json\s*(.*?)```", 1)
    first, last = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    bare = F.when((first > 0) & (last >= first), F.substr(reply, first, last - first + 1))
    return F.when(F.regexp_like(reply, F.lit(r"(?s)```json\s*.*?```")), fenced).otherwise(bare)


def input_budget(window: Column, margin: Column, reserve: Column) -> Column:
    return (F.floor(window * (1 - margin)) - reserve).cast("long")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def per_thousand(correct: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.bround(1000 * correct / tokens, 3)).otherwise(F.lit(0.0))
