"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes in one global
   order: ordinary shingles by hash, then those that stand in many documents, rarer first. Equal
   sets are one node from here on.
2. Sets at or above the threshold share a shingle among their prefixes, so nodes meet on prefix
   shingles, under length and positional bounds, and a pair must share as many as prefixes of that
   length have to. First every node meets only the leader of each of its shingles; links found there join
   most of a group of copies. Then nodes of *different* components that share prefix shingles meet. No pair inside a component is made again.
   Where more than HUB_FROM nodes hold a shingle, each is compared with a hub, one of them, and
   is from then on the set of its differences from the hub. The symmetric difference of two sets is that
   of their difference sets, so two nodes that are not both linked to the hub reach the threshold only
   if they share enough differences; these are rare, and a prefix filter over them finds the pairs.
   So a group of copies costs its size, not its square, and no link between components is lost.
3. A leader's candidates form a prefix tree (sequences in the global order, shared prefixes
   once); the tree is walked with the leader's set, nodes' overlaps are shared by what lies
   below, and subtrees whose remaining length cannot reach the threshold are pruned. Large
   candidate lists are split into blocks.
4. Components by alternating star contraction over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, give_back, materialise

#: The order of frequent shingles is a broadcast of at most so many; the bar rises until it fits.
FREQUENT_LIMIT = 1_000_000
FREQUENT_FROM = 4
#: Counted while reading: shingles seen at least so often within a buffer of BUFFER shingles.
LOCAL_FROM, BUFFER = 2, 1_000_000
#: Prefixes are longer than one common element needs, by n / SHARED_PART, and pairs must share so many more.
SHARED_PART = 24
#: Rounds in which nodes meet leaders only, and the share of the needed common elements asked for there.
LEADER_ROUNDS, LEADER_SHARE = 2, 0.3
#: Shingles that more nodes hold are met by way of a hub; at most so many nodes meet directly.
HUB_FROM = 64
#: Candidates of one leader that are walked in one task.
BLOCK = 512
#: Texts that a worker gets at once.
BATCH_ROWS = 1000
#: Links that a task makes stars of at once.
LINKS_AT_ONCE = 200_000
#: Lists of nodes are broadcast only up to so many entries.
BROADCAST_NODES = 500_000
#: Prefix elements that a task of ``repeated`` reads, bits and hash functions of its filter for each that it finds twice, elements that are dealt out at once.
DEALT, FILTER_BITS, FILTER_HASHES, DEAL_AT_ONCE = 1_000_000, 10, 5, 2_000_000
_TEXT_BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20260711))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: bytes, places: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """A hash for each word of lower-cased bytes, and with ``places`` where the words start."""
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    words = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return (words, start) if places else words


def shingle_set(utf8: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole text where it has fewer."""
    if not utf8:
        return np.zeros(0, np.uint64)
    utf8, parts, at = utf8.lower(), [], 0
    while at < len(utf8):
        end = at + _TEXT_BLOCK
        while end < len(utf8) and not _SPACE[utf8[end]]:
            end += 1
        parts.append(_word_hashes(utf8[at:end]))
        at = end
    words = np.concatenate(parts)
    k = min(size, len(words))
    if not k:
        return words
    run = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        run = _mix(run * _BASE + words[i : len(words) - k + 1 + i])
    return np.unique(run)


def shingle_sets(texts: list[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text; short texts are hashed together."""
    held: list[bytes] = []
    room = _TEXT_BLOCK

    def flush() -> Iterator[np.ndarray]:
        joined = b"\n".join(held).lower()
        ends = np.cumsum([len(t) + 1 for t in held])
        words, start = _word_hashes(joined, True)
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        m = max(0, len(words) - size + 1)
        run = np.full(m, size, np.uint64)
        for i in range(size):
            run = _mix(run * _BASE + words[i : m + i])
        for t, a, b in zip(held, bounds[:-1], bounds[1:], strict=True):
            if b - a < size:
                yield shingle_set(t, size)
            else:
                mine = np.sort(run[a : b - size + 1])
                yield mine[np.concatenate([[True], mine[1:] != mine[:-1]])]

    for text in texts:
        text = text or b""
        if held and len(text) > room:
            yield from flush()
            held, room = [], _TEXT_BLOCK
        if len(text) > _TEXT_BLOCK:
            yield shingle_set(text, size)
        else:
            held.append(text)
            room -= len(text)
    if held:
        yield from flush()


def _node(hashes: np.ndarray) -> int:
    weights = _mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
    total = _mix(np.array([(hashes * weights).sum(dtype=np.uint64) ^ np.uint64(len(hashes))], np.uint64))
    return int(total.view(np.int64)[0])


def _ordered(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(frequent) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    often = frequent[at] == hashes
    return np.concatenate([hashes[~often], hashes[often][np.argsort(rank[at[often]])]])


def prefix_length(n: int, percent: int) -> int:
    """So many first elements of a set of ``n`` share ``shared_least(n)`` with those of any set at or above the threshold."""
    return n - -(-percent * n // 100) + 1 + n // SHARED_PART


def walk(query: np.ndarray, sets: list[np.ndarray], percent: int, step: int = 64) -> list[int]:
    """Which of ``sets`` reach the threshold with ``query``: a walk of their prefix tree.

    Sequences sorted by their bytes are the tree's leaves from left to right: the part that two
    neighbours share is their common path, whose overlaps are kept in ``reached``.
    """
    lookup, found = np.sort(query), []
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    last: np.ndarray = np.zeros(0, np.uint64)
    reached = np.zeros(1, np.int64)  # overlap after so many elements of the current path
    for i in order:
        s = sets[i]
        m = min(len(s), len(last), len(reached) - 1)
        differ = np.flatnonzero(s[:m] != last[:m])
        depth = int(differ[0]) if len(differ) else m
        path = [reached[: depth + 1]]
        need = -(-percent * (len(query) + len(s)) // (100 + percent))
        overlap = int(reached[depth])
        while depth < len(s) and overlap + min(len(s) - depth, len(query) - overlap) >= need:
            part = s[depth : depth + step]
            at = np.minimum(np.searchsorted(lookup, part), len(lookup) - 1)
            path.append(overlap + np.cumsum(lookup[at] == part))
            overlap, depth = int(path[-1][-1]), depth + len(part)
        last, reached = s, np.concatenate(path)
        if depth == len(s) and overlap >= need:
            found.append(i)
    return found


def differences(hub: np.ndarray, elements: np.ndarray, percent: int) -> tuple[np.ndarray, int, bool]:
    """A set's differences from the hub, how many of them any partner shares at least, and whether the two link.

    Sets at or above the threshold that are not both linked to the hub share one difference or more.
    """
    found = np.setxor1d(elements, hub, assume_unique=True)
    beyond = len(found) * (100 + percent) - (len(elements) + len(hub)) * (100 - percent)
    return found, max(1, -(-beyond // (2 * (100 + percent)))), beyond <= 0


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links a-b join: each node, but the least of its part, with that least node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of so many links at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LINKS_AT_ONCE:
            yield flush()
            held = []
    if held:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links(a, b)``; alternating star contraction.

    Each task first makes stars of its own links, so long chains are short before they are shuffled."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = materialise(edges.mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
        seen = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks of shingles that stand in many documents, by counts over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= LOCAL_FROM
            return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(times[often])], ["hash", "times"])

        for batch in batches:
            for elements in shingle_sets(batch.column(0).to_pylist(), size):
                held.append(elements)
                n += len(elements)
                if n >= BUFFER:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        held.clear()
        give_back()

    counted = materialise(docs.select("text").mapInArrow(count, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("df")).where(F.col("df") >= FREQUENT_FROM))
    bar = FREQUENT_FROM
    while counted.where(F.col("df") >= bar).count() > FREQUENT_LIMIT:
        bar *= 2
    pdf = counted.where(F.col("df") >= bar).toPandas()
    hashes, df = pdf["hash"].to_numpy(np.int64).view(np.uint64), pdf["df"].to_numpy(np.int64)
    order = np.lexsort((hashes, df))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_hash = np.argsort(hashes)
    return hashes[by_hash], rank[by_hash]


def _dealt(elements: np.ndarray, buckets: int) -> np.ndarray:
    """Each element's bucket in the upper half, and 32 more of its bits in the lower."""
    low = np.uint64(0xFFFFFFFF)
    return (elements >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | elements & low


def _places(dealt: np.ndarray, sizes: np.ndarray | int) -> Iterator[np.ndarray]:
    """The places of dealt elements in filters of such sizes in bits, one array for each hash function."""
    x = _mix(dealt + np.uint64(1))
    step = x >> np.uint64(32) | np.uint64(1)
    for i in range(FILTER_HASHES):
        yield ((x + np.uint64(i) * step) % np.asarray(sizes, np.uint64)).astype(np.int64)


class Repeated:
    """Filters, one for each bucket, of elements that stand in two rows at least; may hold others too."""

    def __init__(self, filters: list[bytes]):
        self.sizes = np.array([8 * len(f) for f in filters], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:-1])]).astype(np.int64)
        self.bits = np.frombuffer(b"".join(filters), np.uint8)

    def holds(self, elements: np.ndarray) -> np.ndarray:
        dealt = _dealt(elements, len(self.sizes))
        bucket = (dealt >> np.uint64(32)).astype(np.int64)
        held = np.ones(len(elements), bool)
        for at in _places(dealt, self.sizes[bucket]):
            at += self.starts[bucket]
            held &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return held


def repeated(signed: DataFrame) -> Repeated:
    """Which elements of ``signed(prefix)`` stand in two rows or more.

    Most stand in one and would be shuffled with their node only to be dropped: here four bytes of each are shuffled, and filters come back."""
    buckets = max(1, -(-(signed.agg(F.sum(F.size("prefix"))).first()[0] or 0) // DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            dealt = np.sort(_dealt(np.concatenate(held), buckets))
            bounds = np.searchsorted(dealt, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(np.diff(bounds))
            low = dealt.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[bounds[b] : bounds[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "low"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy().view(np.uint64))
            if sum(map(len, held)) >= DEAL_AT_ONCE:
                yield flush()
                held = []
        if held:
            yield flush()
        held.clear()
        give_back()

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        low = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in group["low"]]))
        twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.uint64) | np.uint64(bucket << 32)
        size = 8 * (len(twice) * FILTER_BITS // 8 + 1)
        bits = np.zeros(size, bool)
        for at in _places(twice, size):
            bits[at] = True
        return pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = signed.select("prefix").mapInArrow(deal, "bucket int, low binary").groupBy("bucket").applyInPandas(sift, "bucket int, bits binary")
    got = dict(materialise(found).toPandas().itertuples(index=False))
    return Repeated([got.get(b, b"\0") for b in range(buckets)])


def _opened(block: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's query and its set, its candidates and theirs; rows that repeat a doc_id and a text count once."""
    query = block["b"].isna().to_numpy()
    own = np.frombuffer(block["elements"][query].iloc[0], np.uint64)
    rest = block[~query].drop_duplicates("node")
    return int(block["a"].iloc[0]), own, rest["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rest["elements"]]


class Sets:
    """Shingle sets of nodes, made from their texts where they are compared.

    ``texts(doc_id, text)`` and ``nodes(node, doc_id)``; ``order`` is a broadcast of the frequent shingles and their ranks."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, size: int, percent: int, order):
        self.texts, self.nodes, self.size, self.percent, self.order = texts, nodes, size, percent, order

    def by_block(self, pairs: DataFrame):
        """The sets of pairs (a, b), grouped into blocks of candidates b with their query a.

        A text is read once and its set sent to every block where it is the query (b is null) or
        a candidate."""
        size, order = self.size, self.order
        blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        queries = blocks.select(F.col("a").alias("node"), F.col("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"))
        candidates = pairs.join(blocks, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b")
        places = queries.union(candidates).groupBy("node").agg(F.collect_list(F.struct("a", "block", "b")).alias("places"))
        named = materialise(places.join(self.nodes, "node").select("doc_id", "node", "places"))
        if (named.agg(F.sum(F.size("places") + 1)).first()[0] or 0) <= BROADCAST_NODES:
            named = F.broadcast(named)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, rank = order.value
            for batch in batches:
                rows: list[tuple] = []
                for node, places, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2).to_pylist(), size), strict=True):
                    if _node(s) == node:  # else another row with this doc_id
                        elements = _ordered(s, frequent, rank).tobytes()
                        rows += [(p["a"], p["block"], p["b"], elements) for p in places]
                        if len(rows) >= 2048:
                            yield sent(rows)
                            rows = []
                if rows:
                    yield sent(rows)
            give_back()

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["a", "block", "b", "elements"])

        sets = self.texts.join(named, "doc_id").select("node", "places", "text").mapInArrow(send, "a long, block int, b long, elements binary")
        # Pandas reads a column with nulls as doubles, so candidates' ids travel in a column without.
        return sets.withColumn("node", F.coalesce("b", "a")).groupBy("a", "block")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those at or above the threshold."""
        percent = self.percent

        def check(block: pd.DataFrame) -> pd.DataFrame:
            a, own, ids, sets = _opened(block)
            return pd.DataFrame({"a": a, "b": ids[walk(own, sets, percent)]}, dtype="int64")

        return materialise(self.by_block(pairs).applyInPandas(check, "a long, b long").distinct())

    def from_hubs(self, members: DataFrame) -> DataFrame:
        """For pairs (a, b) of hub and node: the node's differences from the hub."""
        percent = self.percent

        def differ(block: pd.DataFrame) -> pd.DataFrame:
            a, own, ids, sets = _opened(block)
            found = [differences(own, s, percent) for s in sets]
            columns = {"tokens": [t.view(np.int64) for t, _, _ in found], "least": [k for _, k, _ in found], "linked": [x for _, _, x in found]}
            return pd.DataFrame({"hub": a, "node": ids, "n": [len(s) for s in sets], **columns})

        kinds = "hub long, node long, n long, tokens array<long>, least long, linked boolean"
        return materialise(self.by_block(members).applyInPandas(differ, kinds))


def by_hubs(sets: Sets, common: DataFrame, weight: Column, links: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, components and pairs still to be verified of ``common(token, node, n)``: tokens that many nodes hold.

    ``weight`` tells of a node's rows in ``common`` how apt it is as a hub; ``links(a, b)`` and ``joined(node, component)`` are what is known."""
    # The hub of a shingle is the node with the largest share of common shingles: the fewest of its own.
    percent = sets.percent
    share = common.groupBy("node").agg(weight.alias("share"))
    hubs = common.join(share, "node").groupBy("token").agg(F.max(F.struct("share", F.xxhash64("node").alias("draw"), "node")).alias("hub"))
    # A hub need not hold the shingle: that of all shingles of the first choice is taken, so a group has few hubs.
    better = common.join(hubs, "token").groupBy("node").agg(F.max("hub").alias("better"))
    hubs = hubs.join(better, F.col("hub.node") == F.col("node")).select("token", F.col("better").alias("hub"))
    members = materialise(common.join(hubs, "token").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    near = members.limit(0)
    if members.limit(1).count():
        differing = sets.from_hubs(members)
        links = materialise(links.union(differing.where("linked").select("hub", "node")))
        joined = materialise(components(links))
        differing = differing.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        differing = materialise(differing.select("hub", "node", "n", F.size("tokens").cast("long").alias("size"), "least", "component", F.explode("tokens").alias("token")))
        # Rarest differences of the hub's nodes first; only prefixes are kept.
        # Counted before it is shuffled: a difference that most nodes of a hub have would else be one task's.
        held = materialise(differing.groupBy("hub", "token").agg(F.count("*").alias("df")).where("df > 1"))
        if held.count() <= BROADCAST_NODES:
            held = F.broadcast(held)
        differing = differing.join(held, ["hub", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("pos", F.row_number().over(W.partitionBy("hub", "node").orderBy("df", "token")) - 1)
        differing = materialise(differing.where("size - pos >= least"))
        a, b = differing.alias("a"), differing.alias("b")
        both = (F.col("a.size") + F.col("b.size")) * (100 + percent) - (F.col("a.n") + F.col("b.n")) * (100 - percent)
        need = F.ceil(both / F.lit(2 * (100 + percent)))
        within = (F.col("a.size") - F.col("a.pos") >= need) & (F.col("b.size") - F.col("b.pos") >= need)
        same = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.token") == F.col("b.token"))
        met = a.join(b, same & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & within)
        near = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return links, joined, near


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest doc_id reachable by links, the document included. Texts with
    fewer than ``size`` words are one shingle; null, empty or blank texts have none and are linked with
    nothing. Repeated rows keep a row each; a row without doc_id is linked with equal sets only, and names no
    component, which is null if it has no other member. Other columns are not carried. An empty table gives no rows.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _joined(_texts(docs, id_col, text_col), size, percent)


def _joined(texts: DataFrame, size: int, percent: int) -> DataFrame:
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(_frequent(texts, size))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = order.value
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), size):
                nodes.append(_node(s) if len(s) else None)
                sizes.append(len(s))
                prefixes.append(_ordered(s, frequent, rank)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "node", "n", "prefix"]
            )
        give_back()

    signed = materialise(texts.mapInArrow(signatures, "doc_id long, node long, n long, prefix array<long>"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    sets = Sets(texts, nodes, size, percent, order)
    token = W.partitionBy("token")
    named = signed.where("node is not null and doc_id is not null")
    often = spark.sparkContext.broadcast(repeated(named))

    def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            tokens = batch.column(2).flatten().to_numpy()
            held = np.flatnonzero(often.value.holds(tokens.view(np.uint64)))
            row = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows = batch.select(["node", "n"]).take(pa.array(row[held]))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[held]), *rows.columns, pa.array(pos[held], pa.int32())], ["token", "node", "n", "pos"])
        give_back()

    postings = (
        named.select("node", "n", "prefix").mapInArrow(met_again, "token long, node long, n long, pos int")
        .repartition("token").distinct()
        .withColumn("low", F.min("node").over(token)).withColumn("high", F.max("node").over(token)).where("low <> high")
    )
    postings = materialise(postings.select("token", "node", "n", "pos"))
    often.destroy()

    def possible(a, b):
        """Length and positional bounds for two nodes that hold a common element at their positions."""
        need = F.ceil((a["n"] + b["n"]) * F.lit(percent) / F.lit(100 + percent))
        reach = F.least(a["pos"], b["pos"]) + 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1
        return (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent) & (reach >= need)

    def pairs_of(met: DataFrame, share: float) -> DataFrame:
        """Pairs with at least that share of the common elements that two such prefixes must have."""
        need = 1 + F.floor(F.least("na", "nb") / F.lit(SHARED_PART))
        counted = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("na").alias("na"), F.min("nb").alias("nb"))
        return counted.where(F.col("common") >= need * F.lit(share)).select("a", "b")

    def apart(joined: DataFrame) -> DataFrame:
        """Postings of the shingles that more than one component holds."""
        placed = postings.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = placed.withColumn("low", F.min("component").over(token)).withColumn("high", F.max("component").over(token))
        return placed.where("low <> high").select("token", "node", "n", "pos", "component")

    joined = spark.createDataFrame([], "node long, component long")
    links = spark.createDataFrame([], "a long, b long")
    tried = links
    for r in range(LEADER_ROUNDS):
        # The leader of a shingle is its node with the most links so far.
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        placed = apart(joined).join(degree, "node", "left")
        lead = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("node", F.lit(r)).alias("draw"), "node", "n", "pos", "component")).over(token)
        placed = placed.withColumn("lead", lead).where(F.col("component") != F.col("lead.component"))
        own, other = ({"n": F.col(f"{x}n"), "pos": F.col(f"{x}pos")} for x in ("", "lead."))
        met = placed.where(possible(other, own)).select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
        pairs = materialise(pairs_of(met, LEADER_SHARE).join(tried, ["a", "b"], "left_anti"))
        tried = materialise(tried.union(pairs).union(pairs.select("b", "a")))
        links = materialise(links.union(sets.verified(pairs)))
        joined = materialise(components(links))
    placed = materialise(apart(joined).withColumn("df", F.count("*").over(token)))
    share = F.count("*") / F.first("n")
    links, joined, near = by_hubs(sets, placed.where(F.col("df") > HUB_FROM).select("token", "node", "n"), share, links, joined)
    placed = placed.where(F.col("df") <= HUB_FROM).select("token", "node", "n", "pos").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    a, b = placed.alias("a"), placed.alias("b")
    sides = [{"n": F.col(f"{x}.n"), "pos": F.col(f"{x}.pos")} for x in "ab"]
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & possible(*sides))
    met = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    rest = materialise(pairs_of(met, 1.0).union(near.select("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        joined = materialise(components(links.union(sets.verified(rest))))
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = placed.join(least, "component").select("node", "component_id")
    order.destroy()  # what is returned only reads written tables
    return signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows whose id names their component: one document of each group stays, unlinked ones too.

    Rows with a null id stay. Of rows that repeat an id one stays."""
    judged = jaccard_components(docs, id_col=id_col, **options)
    gone = materialise(judged.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    if gone.count() <= BROADCAST_NODES:
        gone = F.broadcast(gone)
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if judged.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(id_col).isNull()).union(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return kept
