"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

A word's frequency vector counts its letters in GROUPS groups. One inserted letter adds one to one count, one deleted
letter takes one away, a replaced one does both, so words that are near differ by a surplus and a deficit of one at
most. Words are the leaves of a trie whose levels are the counts in turn; a depth-first search goes down with the
words that look for partners and spends their budget of one surplus and one deficit, and what reaches a leaf is verified.

Spark counts the trie's upper nodes and cuts it where a subtree holds at most ``SUBTREE`` words; a subtree is a
group, a word goes to its own and, as one that looks for partners, to those that its budget reaches. Words are only
looked for by shorter ones and by equally long ones, so a pair is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, batches_of, give_back, materialise

GROUPS = 16
#: Words of one subtree, and words that look for partners there, in one task.
SUBTREE, SEEKERS = 8_000, 20_000
#: The trie's upper nodes are sent to all tasks, at most so many; subtrees grow until they fit.
UPPER_NODES = 200_000
#: Below so many pairs, vectors are compared at once instead of going further down.
AT_ONCE = 4_096
#: Words up to this length are verified together, longer ones one by one.
TOGETHER = 48
WORD_ROWS = 20_000
LETTERS = "[^A-Za-z\\u00C0-\\u00FF]+"


def occurrences(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Column]:
    """Every maximal run of letters of every text, a row each (``run``), and its lower-cased form: only A-Z are lower-cased."""
    runs = docs.withColumn("run", F.explode(F.split(text_col, LETTERS))).where("run <> ''")
    # Lower-casing is cheap where all letters are ASCII.
    plain = F.octet_length("run") == F.char_length("run")
    return runs, F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))


def damaged(run: Column, key: Column, one_in: int) -> Column:
    """A run without one of its code points, where ``one_in`` divides the CRC-32 of ``<key>:<run>``; else, or without a key, the run."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, text_col: str = "text", least_length: int = 5, least_times: int = 3, damage: tuple[str, int] | None = None) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences; ``damage``: (key column, one in so many runs loses a letter)."""
    key = damage[0] if damage else None
    runs, run = occurrences(docs.select(F.col(text_col).alias("text"), *([F.col(key).alias("key")] if key else [])))
    words = runs.select(run.alias("run"), *(["key"] if key else []))
    words = words.select((damaged(F.col("run"), F.col("key"), damage[1]) if damage else F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each word by group, code point modulo GROUPS."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def spent(seeker: np.ndarray, count: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who can go to a count from his own, and what of his budget is spent then."""
    more = count - seeker
    s, d = surplus + (more == 1), deficit + (more == -1)
    return (np.abs(more) <= 1) & (s <= 1) & (d <= 1), s, d


def upper_trie(nodes: list[tuple[tuple[int, ...], int]]) -> dict:
    """Nested levels of the cut trie from (counts, number) of its lower ends."""
    root: dict = {}
    for counts, number in nodes:
        at = root
        for c in counts[:-1]:
            at = at.setdefault(c, {})
        at[counts[-1]] = number
    return root


def reached(trie: dict, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``own``, number of a subtree) of all subtrees that a word's budget reaches; depth first."""
    rows, numbers = [], []
    start = np.arange(len(own))
    stack = [(trie, 0, start, np.zeros(len(own), np.int32), np.zeros(len(own), np.int32))]
    while stack:
        node, level, at, surplus, deficit = stack.pop()
        for count, child in node.items():
            go, s, d = spent(own[at, level], np.int32(count), surplus, deficit)
            if not go.any():
                continue
            if isinstance(child, dict):
                stack.append((child, level + 1, at[go], s[go], d[go]))
            else:
                rows.append(at[go])
                numbers.append(np.full(len(rows[-1]), child))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(numbers)


def search(entries: np.ndarray, seekers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``entries`` and ``seekers`` whose vectors are within the budget; entries as a trie, walked depth first.

    An entry is at most one letter longer than who seeks it, and not shorter."""
    order = np.lexsort(entries.T[::-1])
    leaves = entries[order]
    none = np.zeros(len(seekers), np.int32)
    stack = [(0, len(leaves), 0, np.arange(len(seekers)), none, none)]
    while stack:
        low, high, level, at, surplus, deficit = stack.pop()
        if level < GROUPS and (high - low) * len(at) > AT_ONCE:
            column = leaves[low:high, level]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                go, s, d = spent(seekers[at, level], column[a], surplus, deficit)
                if go.any():
                    stack.append((low + a, low + b, level + 1, at[go], s[go], d[go]))
            continue
        # At a leaf, or few enough to be compared at once, some entries at a time.
        step = max(1, AT_ONCE // max(1, len(at)))
        for a in range(low, high, step):
            more = leaves[a : min(a + step, high), None, level:] - seekers[None, at, level:]
            s, d = surplus + (more > 0).sum(axis=2), deficit + (more < 0).sum(axis=2)
            fit = (np.abs(more) <= 1).all(axis=2) & (s <= 1) & (d <= s)
            e, q = np.nonzero(fit)
            if len(e):
                yield order[a + e], at[q]


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words from the left and, in a second array, from the right; and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max(initial=1))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), np.uint32), np.zeros((len(words), width), np.uint32)
    left[row, place] = codes
    right[row, np.repeat(lengths, lengths) - 1 - place] = codes
    return left, right, lengths


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, most = min(len(a), len(b)), max(len(a), len(b))
    p = next((i for i in range(short) if a[i] != b[i]), short)
    s = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return p + s >= most - 1


def near_pairs(entries: list[str], seekers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``entries`` and ``seekers`` that are near; a pair of equally long words is sought from the smaller one."""
    found = []
    wide = max(map(len, [*entries, *seekers]), default=0) > TOGETHER
    if not wide and entries and seekers:
        el, er, en = _padded(entries)
        sl, sr, sn = _padded(seekers)
        width = min(el.shape[1], sl.shape[1])
        el, er, sl, sr = el[:, :width], er[:, :width], sl[:, :width], sr[:, :width]
    if not entries or not seekers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for e, q in search(vectors(entries), vectors(seekers)):
        if wide:
            keep = np.array([one_apart(entries[i], seekers[j]) and (len(entries[i]) > len(seekers[j]) or seekers[j] < entries[i]) for i, j in zip(e, q, strict=True)])
        else:
            same_left, same_right = el[e] == sl[q], er[e] == sr[q]
            short = np.minimum(np.minimum(en[e], sn[q]), width)
            p = np.minimum(np.where(same_left.all(axis=1), width, same_left.argmin(axis=1)), short)
            s = np.minimum(np.where(same_right.all(axis=1), width, same_right.argmin(axis=1)), short)
            first = np.minimum(p, width - 1)
            smaller = sl[q, first] < el[e, first]
            keep = (p + s >= np.maximum(en[e], sn[q]) - 1) & np.where(en[e] == sn[q], (p < short) & smaller, en[e] == sn[q] + 1)
        if keep.any():
            found.append((e[keep], q[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([e for e, _ in found]), np.concatenate([q for _, q in found])


def _counted(words: DataFrame) -> DataFrame:
    """Adds ``counts``, the frequency vector as an array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(0).to_pylist())
            counts = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, GROUPS), pa.int32()), pa.array(found.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["word", "n", "counts"])

    return words.select("word", "n").mapInArrow(add, "word string, n long, counts array<int>")


def cut_trie(counted: DataFrame, subtree: int) -> list[tuple[tuple[int, ...], int]]:
    """(counts, words) of the nodes where the trie is cut: of at most ``subtree`` words, or at the lowest level.

    Nodes are counted by Spark level by level; the driver only sees those above the cut and at it."""
    ends: list[tuple[tuple[int, ...], int]] = []
    rest = counted.select("counts")
    for level in range(1, GROUPS + 1):
        sizes = rest.groupBy(F.slice("counts", 1, level).alias("node")).agg(F.count("*").alias("words"))
        done = level == GROUPS
        small = sizes.where(F.lit(done) | (F.col("words") <= subtree)).collect()
        ends += [(tuple(r["node"]), r["words"]) for r in small]
        large = [] if done else sizes.where(F.col("words") > subtree).select("node").collect()
        if not large or len(ends) > UPPER_NODES:
            return ends
        deeper = F.broadcast(counted.sparkSession.createDataFrame([(r["node"],) for r in large], "node array<int>"))
        rest = counted.join(deeper, F.slice("counts", 1, level) == F.col("node"), "left_semi").select("counts")
    return ends


def near_words(words: DataFrame, subtree: int = SUBTREE, seekers: int = SEEKERS) -> DataFrame:
    """(a, na, b, nb): all pairs of ``words(word, n)`` one code point apart, each once."""
    counted = materialise(_counted(words))
    while len(ends := cut_trie(counted, subtree)) > UPPER_NODES:
        subtree *= 2
    if not ends:
        return words.sparkSession.createDataFrame([], "a string, na long, b string, nb long")
    # Only nodes of the lowest level hold more than a subtree's words: theirs are dealt to several blocks.
    blocks = np.array([-(-size // subtree) for _, size in ends], np.int64)
    trie = words.sparkSession.sparkContext.broadcast(upper_trie([(counts, i) for i, (counts, _) in enumerate(ends)]))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word's places: its own subtree, and those that it looks into."""
        for batch in batches:
            counts = np.asarray(batch.column(2).flatten()).reshape(-1, GROUPS)
            row, subtree_no = reached(trie.value, counts)
            # A word's own subtree is the one that it reaches without spending anything.
            home = np.full(len(counts), -1)
            for i, c in enumerate(counts.tolist()):
                at, level = trie.value, 0
                while isinstance(at, dict):
                    at = at[c[level]]
                    level += 1
                home[i] = at
            whole = np.concatenate([np.arange(len(counts)), row])
            number = np.concatenate([home, subtree_no])
            seeks = np.concatenate([np.zeros(len(counts), bool), np.ones(len(row), bool)])
            taken = batch.take(pa.array(whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(blocks[number]), pa.array(seeks), taken.column(0), taken.column(1)], ["subtree", "blocks", "seeks", "word", "n"]
            )
        give_back()

    with batches_of(words.sparkSession, WORD_ROWS):
        placed = counted.mapInArrow(places, "subtree long, blocks long, seeks boolean, word string, n long")
        # Entries of a large leaf are dealt to its blocks, seekers go to each of them.
        own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")))
        placed = materialise(placed.withColumn("block", F.explode(F.when(F.col("seeks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own))).drop("blocks"))
    trie.destroy()
    crowds = placed.where("seeks").groupBy("subtree", "block").agg(F.ceil(F.count("*") / F.lit(seekers)).cast("int").alias("parts")).where("parts > 1")
    # Broadcast, so that the rows of a crowded subtree are dealt by part and not first brought together.
    crowds = materialise(crowds)
    if crowds.count() <= UPPER_NODES:
        crowds = F.broadcast(crowds)
    placed = placed.join(crowds, ["subtree", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Where too many seek, they are dealt to parts, each with all entries of the block.
    part = F.when(F.col("seeks"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("part", F.explode(part)).drop("parts")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        mine = ~group["seeks"].to_numpy()
        entries, en = group["word"].to_numpy()[mine], group["n"].to_numpy()[mine]
        looking, sn = group["word"].to_numpy()[~mine], group["n"].to_numpy()[~mine]
        e, q = near_pairs(list(entries), list(looking))
        return pd.DataFrame({"a": looking[q], "na": sn[q], "b": entries[e], "nb": en[e]})

    return placed.groupBy("subtree", "block", "part").applyInPandas(meet, "a string, na long, b string, nb long")


def variant_groups(words: DataFrame, times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that is at least ``times`` as
    frequent, else null. ``root`` is where following forms ends, the word itself if it has none. Words are distinct; an empty table
    gives no rows. Forms are ever more frequent, so following them ends; each round doubles the steps taken."""
    words = materialise(words.select("word", "n"))
    pairs = materialise(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).union(pairs.select("b", "a", "na"))
    # The least of (-n, word) is the most frequent and, of these, the smallest.
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    follows = F.col("best_n") >= F.col("n") * times
    joined = materialise(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.near")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n"))
    )
    steps = materialise(joined.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not moved.where("moved").limit(1).count():
            break
        steps = moved.select("word", "root")
    return joined.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
