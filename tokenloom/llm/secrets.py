"""Secret scans: rule matches, and a character convolutional network over further candidates.

Rules give base spans, which always stay. Every other token from 8 characters on is a candidate; a
small convolutional network judges it with its surroundings, in windows over its whole length, of
which the highest score counts. It starts from a fit in numpy on a bounded sample of labelled findings, rule matches
against tokens that no rule takes; then it learns from the whole table: from all rule matches and all tokens
that are not clearly none to it, in parts whose networks are averaged. As it is to find what the rules do not, a
positive's value is also shown in other alphabets and lengths, and mostly with the surroundings of another
token, so that neither the rules' key words nor their shapes decide; negatives are also shown joined to longer
names and paths, and among them are the sample's words that a first fit takes for secrets. Scores are calibrated on the other half of all of these, and the threshold is the highest that keeps the
wanted recall there.
"""

from __future__ import annotations

import copy
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LETTERS = re.compile(r"[A-Za-z]+")
#: Characters of candidates, besides ASCII letters and digits, and their least length.
SYMBOLS, LEAST = "+/_.=~!@#$%^&*-", 8

#: The labelled sample that learning starts from: from about so many documents, at most so many findings, half of them rule matches.
SAMPLE_DOCS, SAMPLE_FINDINGS = 20_000, 4000
#: Labelled windows to learn from: each finding is varied until there are so many of either label.
WINDOWS = 8000
RECALL = 0.98
#: So many words that a first fit scores highest are shown as negatives; a labelled value keeps so many characters.
WORDS, VALUE = 1000, 192
#: So often a fit looks for negatives that it scores this high, which the next leaves out.
DOUBT, DOUBT_ROUNDS = 0.2, 2
#: A token that scores less teaches nothing more; a part of the whole table's findings has about so many of the commoner label,
#: and so many of the rarer if there are; each part is gone through so often, at this rate.
CLEAR, PART, LEAST_PART, PART_EPOCHS, PART_RATE = 0.05, 3000, 8, 3, 0.002
#: Outputs are counted by cells of this width.
CELL = 1e-3
BEFORE, INSIDE, AFTER = 32, 48, 16
LENGTH = BEFORE + INSIDE + AFTER
#: Windows over a longer candidate begin so many characters apart; so many windows are scored at once, and so many characters searched.
STRIDE, AT_ONCE, BLOCK_CHARS = INSIDE // 2, 512, 1 << 18
CHANNELS, WIDTH, FILTERS, EPOCHS = 8, 5, 16, 14
_MEMBER = np.zeros(128, bool)
_MEMBER[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, SYMBOLS)]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all rule matches, in order."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character, LENGTH zeros before, between and after the texts, and where each text starts.

    Printable and control ASCII stand for themselves, all else (and NUL) is 1; so a real ``?`` is no stranger."""
    gap = np.zeros(LENGTH, np.uint8)
    parts, starts, at = [gap], [], LENGTH
    for text in texts:
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [np.where((wide < 128) & (wide > 0), wide, 1).astype(np.uint8), gap]
        starts.append(at)
        at += len(wide) + LENGTH
    return np.concatenate(parts), np.array(starts, np.int64)


def candidates(codes: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of candidate characters that no rule match (rows of starts and ends in ``taken``) touches."""
    edge = np.diff(_MEMBER[np.minimum(codes, 127)] & (codes < 128), prepend=False, append=False)
    start, end = np.flatnonzero(edge).reshape(-1, 2).T
    long = end - start >= LEAST
    start, end = start[long], end[long]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, taken[:, 0], 1)
    np.add.at(covered, taken[:, 1], -1)
    within = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
    free = within[start] == within[end]
    return start[free], end[free]


def windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows over whole candidates, the last of each ending with it, and whose they are."""
    more = np.maximum(0, -(-(end - start - INSIDE) // STRIDE))
    own = np.repeat(np.arange(len(start)), more + 1)
    step = np.arange(len(own)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return np.minimum(start[own] + step * STRIDE, np.maximum(start, end - INSIDE)[own]), own


def window_codes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The windows that start there in candidates that end there: surroundings before, the candidate, surroundings after; 0 pads."""
    stop = np.minimum(end, start + INSIDE)
    inside = start[:, None] + np.arange(INSIDE)
    return np.concatenate([codes[start[:, None] + np.arange(-BEFORE, 0)], np.where(inside < stop[:, None], codes[inside], 0), codes[stop[:, None] + np.arange(AFTER)]], axis=1)


def wordlike(value: str) -> bool:
    """Letters only, but for symbols around and between, each run in one case or capitalised."""
    return not any(map(str.isdigit, value)) and all(p.islower() or p.isupper() or p.istitle() for p in _LETTERS.findall(value))


def excerpt(value: str) -> str:
    """A labelled value, or of a longer one VALUE characters from anywhere in it, always the same."""
    at = zlib.crc32(value.encode("utf-8", "surrogatepass")) % (len(value) - VALUE + 1) if len(value) > VALUE else 0
    return value[at : at + VALUE]


# Alphabets that values are written in.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _LOWER, _DIGITS + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper() + "+/", _DIGITS + _LOWER + _LOWER.upper() + "-_")


def varied(findings: pd.DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of findings (label, before, value, after) and of variants of them, and their labels; both labels are as many."""
    r = random.Random(seed)
    half = max(WINDOWS // 2, *findings["label"].value_counts())
    kinds = {k: list(zip(*(part[c] for c in ("before", "value", "after")), strict=True)) for k, part in findings.groupby("label")}
    around = kinds[False]
    rows: list[tuple[str, str, str]] = []
    for i in range(half):
        before, value, after = kinds[True][i % len(kinds[True])]
        if i >= len(kinds[True]) or r.random() < 0.5:
            letters = r.choice(ALPHABETS)
            size = r.randint(16, max(16, min(len(value), 64))) if r.random() < 0.7 else max(LEAST, len(value))
            value = "".join(r.choices(letters, k=size))
            if r.random() < 0.3:  # a short label in front, as issuers write it
                value = "".join(r.choices(_LOWER, k=r.randint(2, 5))) + r.choice("_-") + value
            if r.random() < 0.7:
                before, _, after = r.choice(around)
        rows.append((before, value, after))
    for i in range(half):
        before, value, after = around[i % len(around)]
        if i >= len(around) or r.random() < 0.25:
            parts = [value, *(r.choice(around)[1] for _ in range(r.randint(1, 3)))]
            parts = [p.strip(SYMBOLS) or p for p in parts]
            style = r.random()
            value = "".join(p.capitalize() for p in parts) if style < 0.3 else r.choice("_-/.").join(parts)
            if r.random() < 0.3:
                value += r.choice("_-/.") + str(r.randrange(10 ** r.randint(1, 8)))
        if r.random() < 0.15:
            value = value.upper()
        if r.random() < 0.2:  # key words do not make a secret
            before = r.choice(kinds[True])[0]
        rows.append((before, value, after))
    return coded(rows, r), np.arange(len(rows)) < half


def coded(rows: list[tuple[str, str, str]], r: random.Random) -> np.ndarray:
    """One window of each (before, value, after)."""
    chosen = []
    for before, value, after in rows:
        codes, _ = codes_of([before[-BEFORE:] + value + after[:AFTER]])
        a = LENGTH + len(before[-BEFORE:])
        start, _ = windows(np.array([a]), np.array([a + len(value)]))
        chosen.append(window_codes(codes, start[[r.randrange(len(start))]], np.array([a + len(value)])))
    return np.concatenate(chosen)


class CharNet:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, one output."""

    def __init__(self):
        r = np.random.default_rng(9)
        self.p = {
            "e": r.normal(0, 0.3, (128, CHANNELS)), "k": r.normal(0, 0.2, (WIDTH * CHANNELS, FILTERS)), "kb": np.zeros(FILTERS),
            "o": r.normal(0, 0.3, 2 * FILTERS), "ob": np.zeros(1),
        }
        inside = np.zeros(LENGTH - WIDTH + 1, bool)
        inside[BEFORE : BEFORE + INSIDE - WIDTH + 1] = True
        self.areas = (np.flatnonzero(inside), np.flatnonzero(~inside))
        self.scale, self.shift, self.threshold = 1.0, 0.0, np.inf

    def forward(self, codes: np.ndarray) -> tuple:
        x = self.p["e"][codes]
        cols = np.concatenate([x[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        y = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        at = [a[y[:, a].argmax(axis=1)] for a in self.areas]
        pooled = np.concatenate([np.take_along_axis(y, i[:, None], 1)[:, 0] for i in at], axis=1)
        return cols, at, pooled, pooled @ self.p["o"] + self.p["ob"][0]

    def fit(self, codes: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        r, m, v, t = np.random.default_rng(4), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        weight = np.where(label, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for i in range(0, len(order), 64):
                mine = order[i : i + 64]
                cols, at, pooled, out = self.forward(codes[mine])
                d = (1 / (1 + np.exp(-out)) - label[mine]) * weight[mine] / len(mine)
                g = {"o": pooled.T @ d, "ob": np.array([d.sum()]), "k": np.zeros_like(self.p["k"]), "kb": np.zeros(FILTERS), "e": np.zeros_like(self.p["e"])}
                back = d[:, None] * self.p["o"] * (pooled > 0)
                rows, filters = np.arange(len(mine))[:, None], np.arange(FILTERS)
                for a, dp in zip(at, (back[:, :FILTERS], back[:, FILTERS:]), strict=True):
                    patch = cols[rows, a]
                    g["k"] += np.einsum("nfc,nf->cf", patch, dp)
                    g["kb"] += dp.sum(axis=0)
                    flow = dp[:, :, None] * self.p["k"].T[None]
                    for j in range(WIDTH):
                        np.add.at(g["e"], codes[mine][rows, a + j], flow[:, :, j * CHANNELS : (j + 1) * CHANNELS])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def score(self, codes: np.ndarray) -> np.ndarray:
        # A convolution of embeddings is a sum of table rows, here one for each pair of neighbours and one for the last.
        taps = [self.p["e"] @ self.p["k"][j * CHANNELS : (j + 1) * CHANNELS] for j in range(WIDTH)]
        pairs = [(taps[j][:, None] + taps[j + 1]).reshape(-1, FILTERS).astype(np.float32) for j in range(0, WIDTH - 1, 2)]
        single = taps[-1].astype(np.float32)
        first, last, n = BEFORE, BEFORE + INSIDE - WIDTH + 1, LENGTH - WIDTH + 1
        pooled = np.zeros((len(codes), 2 * FILTERS))
        for i in range(0, len(codes), AT_ONCE):
            # Positions come first, so that rows are taken and compared in long runs.
            x = np.ascontiguousarray(codes[i : i + AT_ONCE].T).astype(np.intp)
            both = x[:-1] * 128 + x[1:]
            y = single.take(x[WIDTH - 1 :].reshape(-1), axis=0, mode="clip")
            for j, table in enumerate(pairs):
                y += table.take(both[2 * j : 2 * j + n].reshape(-1), axis=0, mode="clip")
            y = y.reshape(n, -1, FILTERS)
            pooled[i : i + AT_ONCE, :FILTERS] = y[first:last].max(axis=0)
            pooled[i : i + AT_ONCE, FILTERS:] = np.maximum(y[:first].max(axis=0), y[last:].max(axis=0))
        out = np.maximum(pooled + np.tile(self.p["kb"], 2), 0) @ self.p["o"] + self.p["ob"][0]
        return 1 / (1 + np.exp(-np.clip(self.scale * out + self.shift, -50, 50)))

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)])

    def scaled(self, out: np.ndarray, label: np.ndarray, count: np.ndarray) -> None:
        a, b = 1.0, 0.0
        for _ in range(300):
            d = (1 / (1 + np.exp(-np.clip(a * out + b, -50, 50))) - label) * count / count.sum()
            a, b = a - 0.05 * (float(d @ out) + 0.001 * a), b - 0.05 * float(d.sum())
        self.scale, self.shift = a, b

    def calibrate_counted(self, out: np.ndarray, label: np.ndarray, count: np.ndarray) -> None:
        """``calibrate`` by how often outputs are: ``out`` ascends and is the lower end of a cell."""
        self.scaled(out, label, count)
        out, upto = out[label], np.cumsum(count[label])
        least = out[int(np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right"))]
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * least + self.shift, -50, 50))))

    def calibrate(self, codes: np.ndarray, label: np.ndarray) -> None:
        """Logistic scaling of the outputs, then the highest threshold with the wanted recall."""
        self.scaled(self.outputs(codes), label, np.ones(len(codes)))
        positive = np.sort(self.score(codes)[label])
        self.threshold = positive[int((1 - RECALL) * len(positive))]


def best_scores(net: CharNet, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The highest score of each candidate's windows."""
    best = np.zeros(len(start))
    first, own = windows(start, end)
    for i in range(0, len(own), 16 * AT_ONCE):
        part = slice(i, i + 16 * AT_ONCE)
        np.maximum.at(best, own[part], net.score(window_codes(codes, first[part], end[own[part]])))
    return best


def train(findings: pd.DataFrame, words: pd.DataFrame | None = None, calibrated: bool = True) -> CharNet:
    """Fits on every other finding of either label, calibrates on the rest; without enough of both nothing is ever added.

    ``findings(key, label, before, value, after)``. A token that no rule takes may be a secret all the same, so what
    an earlier fit doubts is left out of the negatives of the next; ``words`` are negatives that no doubt removes."""
    columns = ["key", "label", "before", "value", "after", "sure"]
    findings = findings.assign(sure=findings["label"].to_numpy(bool))[columns]
    if words is not None and len(words):
        findings = pd.concat([findings, words.assign(label=False, sure=True)[columns]])
    findings = findings.sort_values(["label", "key", "value", "before", "after"])

    def halves() -> tuple[pd.DataFrame, pd.DataFrame]:
        first = findings.groupby("label").cumcount() % 2 == 0
        return findings[first.to_numpy()], findings[~first.to_numpy()]

    net = CharNet()
    for round_ in range(DOUBT_ROUNDS + 1 if calibrated else 1):
        fit, rest = halves()
        if any(len(set(part["label"])) < 2 for part in (fit, rest)):
            return CharNet()
        net = CharNet()
        net.fit(*varied(fit, 1))
        if calibrated and round_ < DOUBT_ROUNDS:
            rows = list(zip(findings["before"], findings["value"], findings["after"], strict=True))
            findings = findings[findings["sure"].to_numpy(bool) | (net.score(coded(rows, random.Random(3))) < DOUBT)]
    if calibrated:
        net.calibrate(*varied(rest, 2))
    return net


def hardest_words(net: CharNet, others: DataFrame) -> pd.DataFrame:
    """Of the sample's words those that an uncalibrated fit scores highest."""
    shared = others.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                codes, at = codes_of([b + v + a for b, v, a in zip(rows["before"], rows["value"], rows["after"], strict=True)])
                start = at + rows["before"].str.len().to_numpy(np.int64)
                yield rows.assign(score=best_scores(shared.value, codes, start, start + rows["value"].str.len().to_numpy(np.int64)))

    scored = others.where("odd < 2 and wordlike").select("key", "before", "value", "after").mapInPandas(score, "key long, before string, value string, after string, score double")
    return scored.orderBy(F.desc("score"), "value", "before").limit(WORDS).toPandas()


def _blocks(texts: Iterator[str], size: int = BLOCK_CHARS) -> Iterator[list[str]]:
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _spans(base: list[list[tuple[int, int, int]]], at: np.ndarray) -> np.ndarray:
    return np.array([(a + o, b + o) for o, found in zip(at, base, strict=True) for a, _, b in found], np.int64).reshape(-1, 2)


def whole_findings(texts: DataFrame, net: CharNet) -> DataFrame:
    """(label, value, before, after, half): each rule match of the table, and each token that ``net`` does not clearly take for none.

    A value is there once; what is no word and may well be a secret is no negative."""
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for block in _blocks(v.as_py() or "" for v in batch.column(0)):
                base = [base_spans(t) for t in block]
                codes, at = codes_of(block)
                start, end = candidates(codes, _spans(base, at))
                best = best_scores(net, codes, start, end)
                found = [(i, _ASSIGN.match(block[i], a, b).start(2) if not kind else a, b, True) for i, spans in enumerate(base) for a, kind, b in spans]
                for k in np.flatnonzero(best >= CLEAR):
                    i = int(np.searchsorted(at, start[k], "right")) - 1
                    a, b = int(start[k] - at[i]), int(end[k] - at[i])
                    if best[k] < DOUBT or wordlike(block[i][a:b]):
                        found.append((i, a, b, False))
                rows += [(label, excerpt(block[i][a:b]), block[i][max(0, a - BEFORE) : a], block[i][b : b + AFTER]) for i, a, b, label in found]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.string()) for c in columns[1:])], ["label", "value", "before", "after"])

    found = texts.where("text is not null").select("text").mapInArrow(find, "label boolean, value string, before string, after string")
    once = found.groupBy("label", "value").agg(F.min(F.struct("before", "after")).alias("around"))
    return once.select("label", "value", "around.before", "around.after", F.pmod(F.xxhash64("value", F.lit(7)), F.lit(2)).cast("int").alias("half"))


def learn_whole(net: CharNet, texts: DataFrame) -> CharNet:
    """``net`` after learning from all findings of one half, calibrated on all of the other; without both labels in both nothing is ever added."""
    net.scale, net.shift = 1.0, 0.0
    found = materialise(whole_findings(texts, net))
    counts = {(r["half"], r["label"]): r["count"] for r in found.groupBy("half", "label").count().collect()}
    if len(counts) < 4:
        return CharNet()
    # Every part is to have both labels, so rare ones make fewer and larger parts.
    parts = [max(1, min(-(-max(n) // PART), min(n) // LEAST_PART)) for n in ([counts[half, label] for label in (False, True)] for half in range(2))]
    order = F.row_number().over(Window.partitionBy("half", "label", "slice").orderBy("deal", "value")) - 1
    # Dealt in turn inside slices by hash, so that parts are even and no label's findings are sorted in one task.
    dealt = found.withColumn("deal", F.xxhash64("value", F.lit(8))).withColumn("slice", F.pmod("deal", F.lit(max(1, sum(counts.values()) // 100_000))))
    dealt = materialise(dealt.withColumn("part", F.pmod(order, F.when(F.col("half") == 0, parts[0]).otherwise(parts[1])).cast("int")).drop("slice", "deal"))
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(net)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["label", "value"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        own = copy.deepcopy(shared.value)
        own.fit(*varied(inside(pdf), 1 + int(pdf["part"].iloc[0])), PART_EPOCHS, PART_RATE)
        return pd.DataFrame({"n": [len(pdf)], "p": [np.concatenate([x.ravel() for x in own.p.values()])]})

    # Each part's network counts as its findings do; sums of decimals do not hang on their order.
    learned = dealt.where("half = 0").groupBy("part").applyInPandas(learn, "n long, p array<double>").select("n", F.posexplode("p").alias("i", "x"))
    means = learned.groupBy("i").agg((F.sum((F.col("x") * F.col("n")).cast("decimal(30,12)")) / F.sum("n")).cast("double").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    for k, x in net.p.items():
        net.p[k], means = means[: x.size].reshape(x.shape), means[x.size :]
    shared = context.broadcast(net)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, label = varied(inside(pdf), 2 + int(pdf["part"].iloc[0]))
        return pd.DataFrame({"cell": np.floor(shared.value.outputs(codes) / CELL).astype(np.int64), "label": label}).value_counts().rename("n").reset_index()

    cells = dealt.where("half = 1").groupBy("part").applyInPandas(measure, "cell long, label boolean, n long").groupBy("cell", "label").agg(F.sum("n").alias("n")).orderBy("cell", "label").toPandas()
    net.calibrate_counted(cells["cell"].to_numpy() * CELL, cells["label"].to_numpy(bool), cells["n"].to_numpy(np.float64))
    return net


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, label, odd, before, value, after) of rule matches and of candidates: 2 with a digit, else 1 with capitals or without letters, else 0."""
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            base = base_spans(text)
            found = [(_ASSIGN.match(text, a, b).start(2) if not kind else a, b, True) for a, kind, b in base]
            codes, (at,) = codes_of([text])
            spans = np.array([(a + at, b + at) for a, _, b in base], np.int64).reshape(-1, 2)
            found += [(a - at, b - at, False) for a, b in zip(*candidates(codes, spans), strict=True)]
            for a, b, label in found:
                value = text[a:b]
                odd = 2 if any(map(str.isdigit, value)) else int(not value.islower())
                rows.append((key, label, odd, wordlike(value), text[max(0, a - BEFORE) : a], excerpt(value), text[b : b + AFTER]))
        yield pd.DataFrame(rows, columns=["key", "label", "odd", "wordlike", "before", "value", "after"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, for every document.

    Spans are kind:start:end in code points (end exclusive) by start, then kind, comma-joined.
    A null text is empty and has no spans. Ties and repeated rows are judged alike; an empty table
    gives no rows; without both kinds of labelled findings the network adds nothing. Ids keep their type; other
    columns are not carried.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    share = min(1_000_000, -(-1_000_000 * SAMPLE_DOCS // max(1, docs.count())))
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000))
    sample = texts.withColumn("key", key).where(F.col("key") < share).where("text is not null").select("key", "text")
    # Read once for each kind, so written once; the sample bounds it.
    findings = materialise(sample.mapInPandas(_labelled, "key long, label boolean, odd int, wordlike boolean, before string, value string, after string"))
    # Candidates are many more than rule matches, and most are words, so each kind has its part; without matches no candidate is needed.
    matches = findings.where("label")
    if share < 1_000_000 and matches.limit(4).count() < 4:  # so rare that the sample has none: those of all documents
        matches = texts.where("text is not null").select(key.alias("key"), "text").mapInPandas(_labelled, findings.schema).where("label")
    positive = matches.orderBy("key", "value", "before").limit(SAMPLE_FINDINGS // 2).toPandas()
    if len(positive):
        others = materialise(findings.where("not label").dropDuplicates(["value"]))
        parts = [others.where(F.col("odd") == odd).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_FINDINGS // 6).toPandas() for odd in range(3)]
        positive = pd.concat([positive, *parts])
    words = None
    if len(positive) and positive["label"].nunique() == 2:
        words = hardest_words(train(positive, calibrated=False), others)
    net = train(positive, words)
    if np.isfinite(net.threshold):
        net = learn_whole(net, texts)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def added(net: CharNet, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        codes, at = codes_of(texts)
        start, end = candidates(codes, _spans(base, at))
        best = best_scores(net, codes, start, end)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k in np.flatnonzero(best >= net.threshold):
            i = int(np.searchsorted(at, start[k], "right")) - 1
            out[i].append((int(start[k] - at[i]), 3, int(end[k] - at[i])))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found, held, size = [], [], 0
            for value in batch.column(1):
                text = value.as_py() or ""
                found.append((base_spans(text), []))
                if not np.isfinite(net.threshold):
                    continue
                held.append(text)
                size += len(text)
                if size >= BLOCK_CHARS or len(found) == batch.num_rows:
                    mine = found[len(found) - len(held) :]
                    for (_, more), spans in zip(mine, added(net, held, [b for b, _ in mine]), strict=True):
                        more += spans
                    held, size = [], 0
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([_listed(sorted(base + more)) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return texts.mapInArrow(scan, f"doc_id {dict(texts.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
