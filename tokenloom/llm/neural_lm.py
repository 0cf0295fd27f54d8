"""Language-model scoring: corpus word counts and a gated recurrent network.

Word counts are taken over all training documents by Spark. The network is trained by truncated
back-propagation in numpy, data-parallel over all training documents: they are dealt to rounds, in
every round each worker starts from the shared weights and runs over its part, block by block, and the
weights are averaged. Its output is factored into classes of words; the words outside its vocabulary form
one class, inside which a word has its share of the corpus counts. Scoring carries the state across
windows, so a document's log-likelihood is over its whole text.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise
from .language_id import fold

#: The network's words and the state's size; the words with counts that workers hold are at most so many.
WORDS, STATE, DICTIONARY = 4096, 16, 160_000
#: A worker trains on about so many tokens, and holds so many of them at once.
WORKER_TOKENS, BLOCK_TOKENS = 2_000_000, 262_144
#: The share of the training documents and the learning rate of each round; every document is in one.
ROUNDS = ((1 / 8, 0.3), (3 / 8, 0.2), (1 / 2, 0.1))
WINDOW, LANES, SCORE_WINDOW = 32, 256, 32
#: No weight goes beyond this, so no logit of a state within -1 and 1 can overflow its exponential.
WEIGHT_LIMIT = 4.0
#: Workers' weights are summed so many at a time, and so many sums may go to the driver.
GATHER = 8
#: No word holds a blank, so this names the end of a text.
END = " "


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Vocabulary 0..v-1 by falling count; v stands for all other words.

    Class k holds the words from k * k on, so the few frequent words are in small classes; the last class is v alone."""

    def __init__(self, v: int, weights: np.ndarray | None = None):
        h = STATE
        self.v = v
        self.class_of = np.append(np.sqrt(np.arange(v)).astype(np.int64), 0)
        self.classes = int(self.class_of.max()) + 1 + (v > 0)
        self.class_of[v] = self.classes - 1
        self.shapes = {"x": (v + 1, 3 * h), "u": (h, 3 * h), "c": (self.classes, h), "cb": (self.classes,), "w": (v + 1, h), "wb": (v + 1,)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.array(np.random.default_rng(5).normal(0, 0.1, size) if weights is None else weights, np.float32)
        self.p = self.views(self.flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Named views of one flat array."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from the last word's row of ``x`` and the state, and what training needs of the step."""
        h = STATE
        r = state @ self.p["u"]
        gates = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
        z, g, rec = gates[:, :h], gates[:, h:], r[:, 2 * h :]
        new = g * rec
        new += x[:, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= z
        after += new
        return after, z, g, new, rec

    @staticmethod
    def _softmax(weights: np.ndarray, bias: np.ndarray, states: np.ndarray, wanted: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Probabilities of the ``wanted`` rows of ``weights``; with ``grads``, also the gradient at the states."""
        e = weights @ states.T
        e += bias[:, None]
        np.exp(e, out=e)
        total, columns = e.sum(axis=0), np.arange(len(wanted))
        out = e[wanted, columns] / total
        if grads is None:
            return out, None
        e /= total
        e[wanted, columns] -= 1
        grads[0][:] += e @ states
        grads[1][:] += e.sum(axis=1)
        return out, e.T @ weights

    def log_probs(self, states: np.ndarray, words: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the words' probabilities; with ``grad``, also the gradient at the states."""
        order = np.argsort(words.astype(np.uint16), kind="stable")  # by class, as classes are runs of words
        states, words = states[order], words[order]
        c = self.class_of[words]
        probs, back = self._softmax(self.p["c"], self.p["cb"], states, c, grad and (grad["c"], grad["cb"]))
        bounds = np.searchsorted(c, np.arange(self.classes))
        for k in range(self.classes - 1):
            if (mine := slice(bounds[k], bounds[k + 1])).start < mine.stop:
                part = slice(k * k, min(self.v, (k + 1) ** 2))
                inside, more = self._softmax(self.p["w"][part], self.p["wb"][part], states[mine], words[mine] - part.start, grad and (grad["w"][part], grad["wb"][part]))
                probs[mine] *= inside
                if back is not None:
                    back[mine] += more
        out = np.empty(len(words), np.float32)
        out[order] = np.log(np.maximum(probs, 1e-37))
        if back is not None:
            back, sorted_back = np.empty_like(back), back
            back[order] = sorted_back
        return out, back

    def train(self, docs: Iterable[np.ndarray], end: int, rate: float) -> int:
        """One pass of truncated back-propagation over all documents, a block of them at a time; returns the tokens."""
        square = np.full(len(self.flat), 1e-4, np.float32)
        held: list[np.ndarray] = []
        size = tokens = 0
        for d in docs:
            held.append(np.append(d, end))
            size += len(held[-1])
            if size >= BLOCK_TOKENS:
                self._train_block(np.concatenate(held), end, rate, square)
                tokens, held, size = tokens + size, [], 0
        if held:
            self._train_block(np.concatenate(held), end, rate, square)
        return tokens + size

    def _train_block(self, stream: np.ndarray, end: int, rate: float, square: np.ndarray) -> None:
        """The state is carried from window to window; what the lanes leave over is a lane of its own."""
        lanes = max(1, min(LANES, len(stream) // (2 * WINDOW)))
        grid = np.concatenate([[end], stream])
        whole = len(stream) // lanes * lanes
        self._train_lanes(grid[: whole + 1], lanes, end, rate, square)
        if whole < len(stream):
            self._train_lanes(grid[whole:], 1, end, rate, square)

    def _train_lanes(self, grid: np.ndarray, lanes: int, end: int, rate: float, square: np.ndarray) -> None:
        length = (len(grid) - 1) // lanes
        inputs, targets = (np.ascontiguousarray(a.reshape(lanes, length).T) for a in (grid[:-1], grid[1:]))
        state = np.zeros((lanes, STATE), np.float32)
        holder = np.zeros_like(self.flat)
        grad = self.views(holder)
        for t0 in range(0, length, WINDOW):
            x, y = inputs[t0 : t0 + WINDOW], targets[t0 : t0 + WINDOW]
            rows, goes_on = self.p["x"][x], (x != end).astype(np.float32)[:, :, None]
            kept = []
            for t in range(len(x)):
                before = state * goes_on[t]
                state, *gates = self.step(rows[t], before)
                kept.append((before, *gates, state))
            before, z, g, new, rec, states = (np.stack(k) for k in zip(*kept, strict=True))
            holder[:] = 0
            _, back = self.log_probs(states.reshape(-1, STATE), y.reshape(-1), grad)
            back = back.reshape(len(x), lanes, STATE)
            to_z, to_new, to_g = (before - new) * z * (1 - z), (1 - z) * (1 - new * new), rec * g * (1 - g)
            carried = np.zeros_like(state)
            drs = np.empty((len(x), lanes, 3 * STATE), np.float32)
            for t in range(len(x) - 1, -1, -1):
                d = back[t] + carried
                dr = drs[t]
                dn = d * to_new[t]
                np.multiply(d, to_z[t], out=dr[:, :STATE])
                np.multiply(dn, to_g[t], out=dr[:, STATE : 2 * STATE])
                np.multiply(dn, g[t], out=dr[:, 2 * STATE :])
                back[t] = dn
                carried = dr @ self.p["u"].T
                carried += d * z[t]
                carried *= goes_on[t]
            drs = drs.reshape(-1, 3 * STATE)
            grad["u"] += before.reshape(-1, STATE).T @ drs
            drs[:, 2 * STATE :] = back.reshape(-1, STATE)  # the word's row adds to the new state directly
            words = x.reshape(-1)
            order = np.argsort(words.astype(np.uint16), kind="stable")
            firsts = np.flatnonzero(np.diff(words[order], prepend=-1))
            grad["x"][words[order[firsts]]] = np.add.reduceat(drs[order], firsts, axis=0)
            holder /= lanes
            square += holder * holder
            holder *= rate
            holder /= np.sqrt(square)
            self.flat -= holder
            np.clip(self.flat, -WEIGHT_LIMIT, WEIGHT_LIMIT, out=self.flat)

    def score(self, docs: list[np.ndarray], end: int) -> np.ndarray:
        """Log10-probability of every document (its words and the end), words outside the vocabulary as their class."""
        lengths = np.array([len(d) for d in docs])
        lanes = int(np.clip(lengths.sum() // 1000, 1, 1024))
        heap, plan = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            load, lane = heapq.heappop(heap)
            plan[lane].append(i)
            heapq.heappush(heap, (load + len(docs[i]), lane))
        loads = np.array([lengths[x].sum() for x in plan])
        longest = [x for x in np.argsort(-loads, kind="stable").tolist() if plan[x]]
        order = [i for x in longest for i in plan[x]]
        if not order:
            return np.zeros(0)
        # Lanes are runs of one array of words, the longest first.
        flat, loads = np.concatenate([docs[i] for i in order]), loads[longest]
        ends = np.cumsum(loads)
        starts, logs = ends - loads, np.empty(len(flat))
        state, last = np.zeros((len(loads), STATE), np.float32), np.full(len(loads), end)
        for t0 in range(0, loads[0], SCORE_WINDOW):
            active = int((loads > t0).sum())
            at = starts[:active] + np.arange(t0, min(t0 + SCORE_WINDOW, loads[0]))[:, None]
            real = at < ends[:active]
            words = flat[np.where(real, at, 0)]
            state, last, states = state[:active], last[:active], []
            inputs = np.concatenate([last[None], words[:-1]])
            rows, goes_on = self.p["x"][inputs], (inputs != end).astype(np.float32)[:, :, None]
            for t in range(len(words)):
                state = self.step(rows[t], state * goes_on[t])[0]
                states.append(state)
            last = words[-1]
            logs[at[real]] = self.log_probs(np.concatenate(states)[real.reshape(-1)], words[real])[0]
        out = np.zeros(len(docs))
        out[order] = np.add.reduceat(logs, np.cumsum([0, *lengths[order[:-1]]]))
        return out / np.log(10)


def _words(docs: DataFrame) -> DataFrame:
    # White space becomes blanks in the same pass that lower-cases: splitting at one character needs no regular expression.
    plain = F.translate("text", UPPER + "\t\n\x0b\x0c\r", LOWER + " " * 5)
    return docs.select(F.explode(F.split(plain, " ")).alias("word")).where("word <> ''")


def _dictionary(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, by falling count, and their counts: all from a bar on that leaves at most DICTIONARY words.

    The bar is one of a fixed number of steps (quarters of a doubling), so the driver gets a short histogram and then the words."""
    step = F.floor(F.log2("c") * 4).cast("int")
    bar, taken = None, 0
    for s, words in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        if (taken := taken + words) > DICTIONARY:
            break
        bar = s
    if bar is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(step >= bar).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return [w.encode() for w in top["word"]], top["c"].to_numpy()


def _gathered(found: DataFrame, workers: int) -> np.ndarray:
    """The mean of the workers' weights by their tokens; summed a few at a time, so that no task or driver holds many."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.add.reduce([np.frombuffer(w, np.float64) for w in part["weights"]])
        return pd.DataFrame({"worker": part["worker"].iloc[:1], "tokens": [part["tokens"].sum()], "weights": [total.tobytes()]})

    while workers > GATHER:
        workers = -(-workers // GATHER)
        found = materialise(found.withColumn("worker", F.pmod("worker", F.lit(workers))).groupBy("worker").applyInPandas(add, found.schema))
    rows = found.orderBy("worker").collect()
    return (np.add.reduce([np.frombuffer(r["weights"], np.float64) for r in rows]) / sum(r["tokens"] for r in rows)).astype(np.float32)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, held_out_part: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are A-Z lower-cased words and one end. Counts are over the documents whose
    crc32(id as text) mod ``parts`` is not ``held_out_part``. ``base_score`` is the smoothed unigram
    log10-probability of the tokens, ``score`` the network's. A null text is empty: its end is its only token.
    A null id is held out; ids keep their type. Repeated rows keep a row each. With no training document every
    score is 0. Other columns are not carried.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(fold(id_col, parts) == held_out_part, F.lit(True))
    texts = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    train = texts.where("not held_out")
    n_docs = train.select("doc_id").count()
    counts = materialise(_words(train).groupBy("word").agg(F.count("*").alias("c")))
    n_words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + n_docs, kinds + bool(n_docs)
    vocabulary, top_counts = _dictionary(counts)
    if n_docs:
        at = int(np.searchsorted(-top_counts, -n_docs))
        vocabulary.insert(at, END.encode())
        top_counts = np.insert(top_counts, at, n_docs)
    size = min(WORDS, len(vocabulary))
    end = vocabulary.index(END.encode()) if n_docs else 0
    if end >= size and n_docs:  # the end always is one of the network's words
        vocabulary[size - 1], vocabulary[end] = vocabulary[end], vocabulary[size - 1]
        top_counts[[size - 1, end]] = top_counts[[end, size - 1]]
        end = size - 1
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(vocabulary)}, top_counts))
    rest_n, rest_v = n - int(top_counts[:size].sum()), v - size

    spare, rest = np.log10(n + 0.5 * (v + 1)), np.log10(rest_n + 0.5 * (rest_v + 1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (ids, known), row = shared.value, TaskContext.get().partitionId() << 40
        logs = np.log10(np.append(known, 0) + 0.5)
        for batch in batches:
            coded, base, extra, n_tokens, n_known, tails = [], [], [], [], [], []
            for text in batch.column(3):
                words = (text.as_py() or b"").lower().split()
                at = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
                tails.append(list(Counter([words[i] for i in np.flatnonzero(at < 0).tolist()]).items()))
                coded.append(np.where(at < 0, size, np.minimum(at, size)).astype(np.uint16).tobytes())
                at = at[at >= 0]
                base.append(logs[at].sum() - spare * len(at) + (logs[end] if n_docs else np.log10(0.5)) - spare)
                # Words of the dictionary outside the vocabulary: their share of the class of other words.
                outside = at[at >= size]
                extra.append(logs[outside].sum() - rest * len(outside))
                n_tokens.append(len(words) + 1)
                n_known.append(len(at) + bool(n_docs))
            rows = np.arange(row, row + len(base))
            row += len(base)
            lengths = np.cumsum([0, *map(len, tails)])
            flat = [x for t in tails for x in t]
            words = pa.StructArray.from_arrays([pa.array([x[0].decode("utf-8", "replace") for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int64())], ["word", "tf"])
            columns = [pa.array(rows), *batch.columns[:3], pa.array(coded, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64())]
            columns += [pa.array(base, pa.float64()), pa.array(extra, pa.float64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), words)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "key", "words", "n_tokens", "n_known", "base_score", "extra", "tail"])

    # Every text is split and looked up once; training and scoring read the codes.
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, key long, words binary, n_tokens long, n_known long, base_score double, extra double, tail array<struct<word string, tf long>>"
    coded = materialise(texts.select("doc_id", "held_out", F.xxhash64("doc_id", "text", F.lit(3)).alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(code, schema))
    weights, dealt = Network(size).flat, 0.0
    for share, rate in ROUNDS if n_docs else ():
        start = spark.sparkContext.broadcast(weights)
        workers = max(1, -(-int(n * share) // WORKER_TOKENS))

        def learn(batches: Iterator[pd.DataFrame], start=start, rate=rate) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            net = Network(size, start.value)
            tokens = net.train((np.frombuffer(w, np.uint16).astype(np.int64) for pdf in batches for w in pdf["words"]), end, rate)
            if tokens:
                yield pd.DataFrame({"worker": [TaskContext.get().partitionId()], "tokens": [tokens], "weights": [(net.flat * np.float64(tokens)).tobytes()]})

        place = (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) + 0.5) / 1_000_000
        # Dealt by a hash of the row, in a fixed order, so that the weights do not depend on the files' layout.
        mine = coded.where(~F.col("held_out") & (place >= dealt) & (place < dealt + share)).select("key", "words").repartition(workers, "key").sortWithinPartitions("key", "words").coalesce(workers)
        found = materialise(mine.mapInPandas(learn, "worker int, tokens long, weights binary"))
        if found.limit(1).count():  # few documents need not reach every round
            weights = _gathered(found, workers)
        dealt += share
        start.destroy()
    start = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, last = Network(size, start.value), end if n_docs else size
        for batch in batches:
            docs = [np.append(np.frombuffer(w, np.uint16).astype(np.int64), last) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(docs, end if n_docs else -1)), *batch.columns[2:]], names=scores)

    carried = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "extra"]
    scores = ["row", "score", *carried]
    scored = coded.select("row", "words", *carried).mapInArrow(score, f"row long, score double, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, extra double")
    # The counts of rarer words are not broadcast: documents' words are joined to them.
    c = F.coalesce("c", F.lit(0))
    tail = (
        coded.select("row", F.inline("tail")).join(counts, "word", "left")
        .select("row", "tf", c.alias("c"))
        .groupBy("row").agg(
            F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - float(spare))).alias("tail_base"),
            F.sum(F.col("tf") * (F.log10(F.col("c") + 0.5) - float(rest))).alias("tail_score"),
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"),
        )
    )
    zero = F.lit(0)
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("score") + F.col("extra") + F.coalesce("tail_score", zero)).alias("score"),
    )
