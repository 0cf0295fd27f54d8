"""Language identification by interpolated Kneser-Ney character models.

One model per language is fitted on a bounded sample of labelled rows and kept as sorted arrays of
n-gram hashes with probabilities. All models are merged into one lookup: a row of
log-probabilities, one for each language, for every n-gram that any language has seen. A text gets
the language of the lowest cross-entropy per character, and is rejected when that is far above
what the language's own calibration texts have at this length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back

ORDER = 4
#: The labelled sample of each language: about so many documents, and at most so many characters.
FIT_DOCS, FIT_CHARS = 600, 4_000_000
#: A text is rejected beyond so many times the largest deviation in the calibration texts, if its
#: cross-entropy also is nearer to that of random letters than to the language's mean.
REJECT_AT = 2.0
#: A score is the share of the best language among exp(-s x nats per character), for the s of these under which the
#: calibration texts' own languages are likeliest.
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0)
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18
_LETTER: list[np.ndarray] = []
_PARTS = ("keys", "contexts", "suffixes", "probs", "context_keys", "gammas")
MODEL = "lang string, k int, floor double, " + ", ".join(f"{p} binary" for p in _PARTS)


def characters(text: str) -> np.ndarray:
    """Lower-cased letters, all else as single spaces, with the padding that the models expect."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    parts = [np.full(ORDER - 1, 32, np.uint32)]
    for at in range(0, len(text), _BLOCK):
        codes = np.frombuffer(text[at : at + _BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(np.where(_LETTER[0][codes], codes, np.uint32(32)))
    codes = np.concatenate([*parts, np.full(1, 32, np.uint32)])
    keep = (codes != 32) | (np.concatenate([[0], codes[:-1]]) != 32)
    keep[: ORDER - 1] = True
    keep[-1] = True  # so that a text without letters still has one character
    return codes[keep]


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER the hash of the k characters that end at every position."""
    x = codes.astype(np.uint64) + np.uint64(1)
    out = [x]
    for k in range(2, ORDER + 1):
        h = np.zeros(len(x), np.uint64)
        h[k - 1 :] = out[-1][k - 2 : -1] * _BASE + x[k - 1 :]
        out.append(h)
    return out


def fit(texts: list[str]) -> list[dict]:
    """Sorted arrays of each order: n-grams, their contexts and suffixes, probabilities, back-off weights."""
    seqs = [characters(t) for t in texts]
    hashes = [np.concatenate(h) for h in zip(*[[x[ORDER - 1 :] for x in _hashes(s)] for s in seqs], strict=True)]
    # Contexts end one character earlier.
    before = [np.concatenate(h) for h in zip(*[[x[ORDER - 2 : -1] for x in _hashes(s)] for s in seqs], strict=True)]
    keys, at, counts = np.unique(hashes[-1], return_index=True, return_counts=True)
    grams = {ORDER: (keys, at, counts)}
    for k in range(ORDER - 1, 0, -1):
        above = grams[k + 1]
        suffix = hashes[k - 1][above[1]]
        keys, first, counts = np.unique(suffix, return_index=True, return_counts=True)
        grams[k] = (keys, above[1][first], counts)
    orders: list[dict] = []
    for k in range(1, ORDER + 1):
        keys, at, counts = grams[k]
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = before[k - 2][at] if k > 1 else np.zeros(len(keys), np.uint64)
        context_keys, where = np.unique(context, return_inverse=True)
        total = np.bincount(where, counts, len(context_keys))
        gamma = discount * np.bincount(where, minlength=len(context_keys)) / total
        if k == 1:
            floor = gamma[0] / (len(keys) + 1)
            lower, suffix = np.full(len(keys), 1 / (len(keys) + 1)), np.zeros(len(keys), np.uint64)
        else:
            suffix = hashes[k - 2][at]
            lower = orders[-1]["probs"][np.searchsorted(orders[-1]["keys"], suffix)]
        probs = np.maximum(counts - discount, 0) / total[where] + gamma[where] * lower
        orders.append({"k": k, "floor": floor, "keys": keys, "contexts": context, "suffixes": suffix, "probs": probs, "context_keys": context_keys, "gammas": gamma})
    return orders


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Models:
    """All languages' models merged: for each order sorted n-grams with a row of log2-probabilities."""

    def __init__(self, models: dict[str, list[dict]]):
        self.langs = sorted(models)
        self.floor = np.log2([models[x][0]["floor"] for x in self.langs]).astype(np.float32)
        self.uniform = float(np.log2(1 + len(np.unique(np.concatenate([m[0]["keys"] for m in models.values()])))))
        self.keys, self.rows, self.context_keys, self.gammas = [], [], [], []
        for k in range(ORDER):
            parts = [models[x][k] for x in self.langs]
            keys, first = np.unique(np.concatenate([p["keys"] for p in parts]), return_index=True)
            contexts, suffixes = (np.concatenate([p[n] for p in parts])[first] for n in ("contexts", "suffixes"))
            context_keys = np.unique(np.concatenate([p["context_keys"] for p in parts]))
            gammas = np.zeros((len(context_keys), len(parts)), np.float32)
            rows = np.empty((len(keys), len(parts)), np.float32)
            for i, p in enumerate(parts):
                gammas[np.searchsorted(context_keys, p["context_keys"]), i] = np.log2(p["gammas"])
                back = self.rows[-1][np.searchsorted(self.keys[-1], suffixes), i] if k else self.floor[i]
                rows[:, i] = gammas[np.searchsorted(context_keys, contexts), i] * bool(k) + back
                rows[np.searchsorted(keys, p["keys"]), i] = np.log2(p["probs"])
            self.keys.append(keys)
            self.rows.append(rows)
            self.context_keys.append(context_keys)
            self.gammas.append(gammas)

    def log2(self, hashes: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        """Log2-probabilities, one column for each language, of the characters at ``where``."""
        out = np.zeros((len(where), len(self.langs)), np.float32)
        rest = np.arange(len(where))
        for k in range(ORDER - 1, -1, -1):
            at, hit = _find(self.keys[k], hashes[k][where[rest]])
            out[rest[hit]] += self.rows[k][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            if k:
                at, hit = _find(self.context_keys[k], hashes[k - 1][where[rest] - 1])
                out[rest[hit]] += self.gammas[k][at[hit]]
        out[rest] += self.floor
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character for each language, and the number of characters, of every text."""
        bits, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        size = done = 0

        def flush() -> None:
            codes = np.concatenate(held)
            ends = np.cumsum([len(h) for h in held])
            where = np.ones(len(codes), bool)
            starts = np.concatenate([[0], ends[:-1]])
            for j in range(ORDER - 1):
                where[starts + j] = False
            where = np.flatnonzero(where)
            values = self.log2(_hashes(codes), where)
            mine = slice(done, done + len(held))
            n[mine] = ends - starts - (ORDER - 1)
            firsts = np.concatenate([[0], np.cumsum(n[mine])[:-1]])
            bits[mine] = -np.add.reduceat(values, firsts, axis=0, dtype=np.float64)

        for text in texts:
            held.append(characters(text))
            size += len(held[-1])
            if size >= _BLOCK:
                flush()
                done, held[:], size = done + len(held), [], 0
        if held:
            flush()
        return bits / np.maximum(n, 1)[:, None], n


def _fitted(labelled: DataFrame) -> Models | None:
    """Models of all languages from rows (key, lang, text): the fit part of a bounded sample."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, size = [], 0
        for text in pdf.sort_values("key")["text"]:
            if size + len(text) > FIT_CHARS and texts:
                break
            texts.append(text)
            size += len(text)
        rows = [{"lang": pdf["lang"].iloc[0], "k": o["k"], "floor": o["floor"]} | {p: o[p].tobytes() for p in _PARTS} for o in fit(texts)]
        return pd.DataFrame(rows)

    rows = labelled.groupBy("lang").applyInPandas(train, MODEL).collect()
    kinds = dict(zip(_PARTS, (np.uint64, np.uint64, np.uint64, np.float64, np.uint64, np.float64), strict=True))
    models: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        models.setdefault(r["lang"], []).append({"floor": r["floor"]} | {p: np.frombuffer(r[p], kinds[p]) for p in _PARTS})
    return Models(models) if models else None


def _deviation(ce: np.ndarray, n: np.ndarray, stats: np.ndarray) -> np.ndarray:
    mean, spread, noise = stats
    return (ce - mean) / np.sqrt(spread + noise / np.maximum(n, 1))


def _calibrated(models: Models, labelled: DataFrame) -> tuple[np.ndarray, float]:
    """For each language: mean bits, variance between texts, variance of one character, largest deviation; and the scores' sharpness."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits, n = models.score(list(pdf["text"]))
            own = [models.langs.index(x) for x in pdf["lang"]]
            rows = np.arange(len(own))
            logs = {f"log{i}": -np.log(np.exp(-s * np.log(2) * (bits - bits[rows, own][:, None])).sum(axis=1)) for i, s in enumerate(SHARPNESS)}
            yield pd.DataFrame({"lang": pdf["lang"], "ce": bits[rows, own], "n": n} | logs)

    logs = [f"log{i}" for i in range(len(SHARPNESS))]
    found = labelled.where(F.col("lang").isin(models.langs)).mapInPandas(measure, "lang string, ce double, n long, " + ", ".join(f"{x} double" for x in logs)).toPandas()
    sharp = SHARPNESS[int(np.argmax(found[logs].mean()))] if len(found) else SHARPNESS[0]
    out = []
    for lang in models.langs:
        ce, n = found.loc[found["lang"] == lang, ["ce", "n"]].to_numpy().T
        if len(ce) < 2:
            out.append((0.0, np.inf, 0.0, 1.0))
            continue
        mean = float(np.average(ce, weights=n))
        square, inverse = (ce - mean) ** 2, 1 / np.maximum(n, 1)
        (spread, noise), *_ = np.linalg.lstsq(np.stack([np.ones_like(inverse), inverse], 1), square, rcond=None)
        stats = np.array([mean, max(spread, 1e-3), max(noise, 1.0)])
        out.append((*stats, max(3.0, float(_deviation(ce, n, stats).max()))))
    return np.array(out), sharp


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, parts: int = 4, held_out_part: int = 2
) -> DataFrame:
    """The ``carry`` columns (all by default) and ``held_out, lang_pred, score, bits_per_char, rejected``.

    Models learn from text and non-null label of rows whose crc32(id as text) mod ``parts`` is not
    ``held_out_part``: a sample of about ``FIT_DOCS`` documents (at most ``FIT_CHARS`` characters) for
    each language, and as many others for calibration. Every row is judged by its whole text. ``score`` is the
    share of the best language among exp(-s x nats per character), s calibrated.

    A null text or one without a letter is ``und``, score 0, and rejected; so is everything when
    nothing can be learned. Ties go to the first language by name. A null id is held out.
    Repeated rows keep a row each; carried columns named like the new ones are replaced.
    """
    new = ("held_out", "lang_pred", "score", "bits_per_char", "rejected")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    held_out = F.coalesce(fold(id_col, parts) == held_out_part, F.lit(True))
    labelled = docs.where(~held_out & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1_000_000, 2_000_000 * FIT_DOCS // v))]) if counts else F.create_map().cast("map<string,int>")
    sample = (
        labelled.select(draw.alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .where(F.col("key") < share[F.col("lang")])
        .where(F.col("text").rlike(r"\p{L}"))
    )
    models = _fitted(sample.where("key % 2 = 0"))
    stats, sharp = _calibrated(models, sample.where("key % 2 = 1")) if models else (None, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast((models, stats, sharp))
    text_key = fresh(docs, "judged_text")
    columns = docs.select(*[F.col(c) for c in carry], held_out.alias("held_out"), F.col(text_col).alias(text_key))
    schema = T.StructType(
        [*columns.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, stats, sharp = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            # Only the padding is left of a text without letters.
            bits, n = models.score([t or "" for t in texts]) if models else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            known = (n > 1) & bool(models)
            best = bits.argmin(axis=1)
            ce = bits[np.arange(len(bits)), best]
            score = 1 / np.exp(-sharp * np.log(2) * (bits - ce[:, None])).sum(axis=1)
            far = np.ones(len(bits), bool)
            if models:
                halfway = (stats[best, 0] + models.uniform) / 2
                far = (_deviation(ce, n, stats[best, :3].T) > REJECT_AT * stats[best, 3]) & (ce > halfway)
            lang = [models.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            new = [pa.array(lang), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, ce, np.nan), mask=~known), pa.array(far | ~known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[f.name for f in schema.fields])
        give_back()

    return columns.mapInArrow(judge, schema)
