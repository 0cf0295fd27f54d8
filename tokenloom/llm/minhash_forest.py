"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by longest common prefix.

1. Every text becomes its set of distinct word shingles and a signature of HASHES minima. Equal sets are one node.
2. Each of TREES orders reads the signature in another sequence of DEEPEST places. All sequences are sorted by range, so a
   node stands beside those with which it shares the longest prefix; nodes that share fewer than LEAST places with both
   neighbours have no partner in that tree.
3. Neighbours of the first trees are confirmed on their full sets, and components of the links found join most of
   a group of copies. No pair inside a component is looked at again.
4. What shares a prefix with another component is in a region of a tree. The depth is adaptive: a region is a prefix of
   LEAST places where at most REGION nodes have it, else it is split by the next place, down to DEEPEST. Nodes of a region
   and different components are all confirmed on their full sets; in regions that stay larger each node is compared with a hub and
   partners are found among its differences from the hub, without a limit on their number.
5. Components by alternating star contraction.

Two sets of similarity s share a region in one tree with a probability of s ** depth; with 40 trees and the lowest depth
of 6 a pair at 0.8 is missed about once in 100,000, and less where regions are small, which is the usual case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, give_back, materialise
from .jaccard_join import BATCH_ROWS, Sets, _node, _texts, by_hubs, components, shingle_sets

HASHES, TREES = 128, 40
#: Places of a prefix: at least, and at most.
LEAST, DEEPEST = 3, 6
#: Regions of more nodes are split, and at the lowest depth met by way of a hub.
REGION = 64
#: Trees whose neighbours are confirmed first.
FIRST_TREES = 8
#: Elements of sets that are hashed at once.
ELEMENTS = 1 << 16
_RNG = np.random.Generator(np.random.PCG64(20261128))
_FACTORS = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ORDERS = np.stack([_RNG.permutation(HASHES)[:DEEPEST] for _ in range(TREES)])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A signature for each set that is not empty: HASHES minima of its elements under as many permutations of 32 bits."""
    out = np.empty((len(sets), HASHES), np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = first + 1
        base = ends[first] - len(sets[first])
        while last < len(sets) and ends[last] - base <= ELEMENTS:
            last += 1
        low = np.concatenate(sets[first:last])
        low = (low >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], ends[first : last - 1] - base])
        mixed = np.empty_like(low)
        for j in range(HASHES):
            np.bitwise_xor(low, _MASKS[j], out=mixed)
            np.multiply(mixed, _FACTORS[j], out=mixed)
            out[first:last, j] = np.minimum.reduceat(mixed, starts)
        first = last
    return out


def branches(signatures: np.ndarray) -> np.ndarray:
    """(signatures, TREES) keys: the number of the tree and the signature's values in the tree's order, as sortable bytes."""
    wide = signatures.astype(">u4")[:, _ORDERS]  # (rows, TREES, DEEPEST)
    keys = np.empty((len(signatures), TREES, 1 + 4 * DEEPEST), np.uint8)
    keys[:, :, 0] = np.arange(TREES)
    keys[:, :, 1:] = np.ascontiguousarray(wide).view(np.uint8).reshape(len(signatures), TREES, 4 * DEEPEST)
    return keys


def shared(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys (a row of bytes each): places that each shares with the one before; -1 for the first, and across trees."""
    places = np.concatenate([keys[:, :1].astype(np.uint32), keys[:, 1:].copy().view(">u4").astype(np.uint32)], axis=1)
    same = np.ones((len(keys), places.shape[1] + 1), bool)
    same[1:, :-1] = places[1:] == places[:-1]
    same[:, -1] = False
    depth = same.argmin(axis=1) - 1
    if len(depth):
        depth[0] = -1
    return depth


def _prefix(depth: int) -> Column:
    return F.xxhash64(F.substring("key", 1, 1 + 4 * depth))


def sorted_orders(nodes: DataFrame) -> DataFrame:
    """(key, node, n, before, n_before) of ``nodes(node, n, signature)`` in each tree, without those that share fewer than LEAST places with both neighbours.

    ``before`` is the neighbour with which the longest prefix is shared to the left, null if that is shorter than LEAST."""
    width = 1 + 4 * DEEPEST

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            signatures = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(rows, HASHES)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), rows * TREES, [None, pa.py_buffer(branches(signatures).tobytes())])
            again = pa.array(np.repeat(np.arange(rows), TREES))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), batch.column(0).take(again), batch.column(1).take(again)], ["key", "node", "n"])
        give_back()

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last row of a batch waits for the next one; the first and last of a partition stay, as their neighbours are elsewhere."""
        held: tuple[np.ndarray, ...] | None = None
        opened = True
        schema = pa.schema([("key", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("before", pa.int64()), ("n_before", pa.int64())])

        def out(keys, node, n, before, n_before, known) -> pa.RecordBatch:
            columns = [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(node), pa.array(n), pa.array(before, mask=~known), pa.array(n_before, mask=~known)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        def judged(keys, node, n, before, n_before, left, right):
            keep = (left >= LEAST) | (right >= LEAST)
            return out(keys[keep], node[keep], n[keep], before[keep], n_before[keep], (left >= LEAST)[keep]) if keep.any() else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            node, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if held is not None:
                keys, node, n = np.concatenate([held[0], keys]), np.concatenate([held[1], node]), np.concatenate([held[2], n])
            left = shared(keys)
            before, n_before = np.concatenate([[0], node[:-1]]), np.concatenate([[0], n[:-1]])
            if held is not None:
                left[0], before[0], n_before[0] = held[3]
            right = np.concatenate([left[1:], [-1]])
            if len(node) > 1:
                if opened:
                    right[0] = DEEPEST  # kept
                    opened = False
                found = judged(keys[:-1], node[:-1], n[:-1], before[:-1], n_before[:-1], left[:-1], right[:-1])
                if found is not None:
                    yield found
            held = (keys[-1:].copy(), node[-1:].copy(), n[-1:].copy(), (left[-1], before[-1], n_before[-1]))
        if held is not None:
            known = np.array([held[3][0] >= LEAST])
            yield out(held[0], held[1], held[2], np.array([held[3][1]]), np.array([held[3][2]]), known)
        give_back()

    planted = nodes.select("node", "n", "signature").mapInArrow(plant, "key binary, node long, n long")
    in_order = planted.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return in_order.mapInArrow(beside, "key binary, node long, n long, before long, n_before long")


def regions(branched: DataFrame, joined: DataFrame) -> DataFrame:
    """(token, node, n, component, size): the regions, of adaptive depth, that hold several components."""
    placed = branched.select("key", "node", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = None
    for depth in range(LEAST, DEEPEST + 1):
        placed = placed.withColumn("token", _prefix(depth))
        sizes = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", "size")
        placed = materialise(placed.join(sizes, "token"))
        here = placed if depth == DEEPEST else placed.where(F.col("size") <= REGION)
        here = here.select("token", "node", "n", "component", "size")
        found = here if found is None else found.union(here)
        placed = placed.where(F.col("size") > REGION).drop("token", "size")
        if depth < DEEPEST and not placed.limit(1).count():
            break
    return found


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles;
    ``component_id`` is the smallest doc_id reachable by links, the document included. Texts with fewer words are one
    shingle; null, empty and blank texts have none and are linked with nothing. Repeated rows keep a row each; a row
    without an id is linked with equal sets only, and its component is null if it has no other member. Other columns are not carried. An
    empty table gives no rows.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _grown(_texts(docs, id_col, text_col), size, percent)


def _grown(texts: DataFrame, size: int, percent: int) -> DataFrame:
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = texts.sparkSession.sparkContext.broadcast(none)  # sets are compared in the order of their hashes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1).to_pylist(), size))
            full = [s for s in found if len(s)]
            signatures = iter(minima(full)) if full else iter(())
            kinds = [("node", pa.int64()), ("n", pa.int64()), ("signature", pa.binary())]
            columns = [[_node(s) if len(s) else None for s in found], [len(s) for s in found], [next(signatures).tobytes() if len(s) else None for s in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)]], ["doc_id", *[k for k, _ in kinds]])
        give_back()

    signed = materialise(texts.mapInArrow(sign, "doc_id long, node long, n long, signature binary"))
    nodes = materialise(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    sets = Sets(texts, nodes.select("node", "doc_id"), size, percent, order)
    branched = materialise(sorted_orders(nodes.where("doc_id is not null")))

    def alike(a: str, b: str) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    beside = branched.where(F.col("before").isNotNull() & alike("n", "n_before") & (F.substring("key", 1, 1) < F.lit(bytes([FIRST_TREES]))))
    tried = materialise(beside.select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct())
    links = sets.verified(tried)
    joined = materialise(components(links))
    placed = materialise(regions(branched, joined))
    links, joined, near = by_hubs(sets, placed.where(F.col("size") > REGION).select("token", "node", "n"), F.count("*"), links, joined)
    a, b = (placed.where(F.col("size") <= REGION).drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).alias(x) for x in "ab")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & alike("a.n", "b.n"))
    met = met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).union(near.select(F.least("a", "b"), F.greatest("a", "b")))
    rest = materialise(met.distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        joined = materialise(components(links.union(sets.verified(rest))))
    named = nodes.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = materialise(named.join(least, "component").select("node", "component_id"))
    order.destroy()  # what is returned only reads written tables
    found = signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``minhash_components`` and ``kept``: the one document of each component that names it; rows without an id are kept."""
    return minhash_components(docs, id_col, **options).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
