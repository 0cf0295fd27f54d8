"""Chunks, BM25 index and search, and packing of ranked chunks into a budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folds import greedy_skip, next_fit
from ..functions.text import strip, terms, token_count
from ..sources.scratch import BROADCAST_ROWS, small, written

#: Tokens that the wrapper of a chunk is reckoned with.
WRAPPER = 12


def chunk_documents(docs: DataFrame, max_tokens: int = 350, sep: str = "\n\n", doc_id: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(doc_id, chunk_no, chunk_id, title, text, tokens): consecutive paragraphs while they fit.

    Token counts add up over white space, so each paragraph is counted once; no shuffle."""
    paras = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sep), strip), lambda p: p != "")
    with_paras = docs.select(F.col(doc_id).alias("doc_id"), F.col(title).alias("title"), paras.alias("paras"))
    bins = with_paras.withColumn("bins", next_fit(F.transform("paras", token_count), max_tokens))
    rows = bins.select("doc_id", "title", "paras", F.posexplode("bins").alias("chunk_no", "b"))
    return rows.select(
        "doc_id", "chunk_no", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"), "title",
        F.array_join(F.slice("paras", F.col("b.first") + 1, F.col("b.n")), sep).alias("text"), F.col("b.tokens").alias("tokens"),
    )


def bm25_index(chunks: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings(term, doc_id, chunk_no, tf, dl), idf(term, df, idf) and one row of statistics.

    With ``wanted(term)`` only these terms' postings are made; a chunk's length still counts all its terms. The chunks' terms
    are written once, as lengths, frequencies and postings all come from them."""
    with_terms = written(chunks.select("doc_id", "chunk_no", terms(F.concat(F.col("title"), F.lit(" "), F.col("text"))).alias("t")))
    stats = with_terms.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_dl"))
    rows = with_terms.select("doc_id", "chunk_no", F.size("t").alias("dl"), F.explode("t").alias("term"))
    if wanted is not None:
        rows = rows.join(small(wanted), "term", "left_semi")
    postings = rows.groupBy("term", "doc_id", "chunk_no", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return postings, idf, stats


def _weighed(queries: DataFrame, chunks: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """postings(term, doc_id, chunk_no, norm) of the queries' terms and weights(query_id, term, weight, most), both written.

    A posting adds weight * norm to a query's score, at most ``most``."""
    query_terms = written(queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    made, _, stats = bm25_index(chunks, written(query_terms.select("term").distinct()))
    # A chunk's postings are to lie together: what a query gets from them is summed before it is shuffled.
    made = made.repartition("doc_id", "chunk_no").crossJoin(F.broadcast(stats.select("avg_dl")))
    postings = written(made.select("term", "doc_id", "chunk_no", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))).alias("norm")))
    lists = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("norm").alias("largest")).crossJoin(F.broadcast(stats.select("n")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = query_terms.join(lists, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"), (F.col("qtf") * idf * F.col("largest")).alias("most"))
    return postings, written(weights)


AT = ["query_id", "doc_id", "chunk_no"]


def _part(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_no, part): what the weights' terms add to each chunk's score."""
    return postings.join(small(weights), "term").groupBy(*AT).agg(F.sum(F.col("weight") * F.col("norm")).alias("part"))


def _ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no")).cast("long"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, chunk_no, score, rank) of all chunks with a query term.

    ``queries(query_id, text)``. Scores are rounded to 6 places before ranking. All chunks that share any term with a query are
    ranked: where only the best are wanted, ``bm25_near`` finds them without scoring the others."""
    postings, weights = _weighed(queries, chunks, k1, b)
    return _ranked(_part(postings, weights).select(*AT, F.round("part", 6).alias("score")).where("score > 0"))


#: A round scores about so many queries, with so many of their terms in all, by as many places (queries times chunks) and sums at a time.
ROUND_QUERIES, ROUND_TERMS, PLACES = 16_384, BROADCAST_ROWS, 500_000
#: Terms of a round that at least every so-many-th query has are multiplied as a matrix, at most so many.
DENSE_SHARE, DENSE = 64, 256
#: Of the chunks of a size or less, so many can be taken at most.
TAKEN = 4


def _lists(chunks: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, chunk_no, tokens, dl, terms, tfs): a chunk's distinct terms, as 64-bit hashes, and how often it has each. Nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            term, of = batch.column(3).flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), dl)
            order = np.lexsort((term, of))
            term, of = term[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])])[: len(term)])
            ends = pa.array(np.searchsorted(of[first], np.arange(batch.num_rows + 1)), pa.int32())
            listed = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(term[first]), pa.array(np.diff(np.append(first, len(term))), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dl, pa.int64()), *listed], ["doc_id", "chunk_no", "tokens", "dl", "terms", "tfs"])

    hashed = F.transform(terms(F.concat(F.col("title"), F.lit(" "), F.col("text"))), lambda t: F.xxhash64(t))
    rows = chunks.select("doc_id", "chunk_no", tokens.cast("long").alias("tokens"), F.coalesce(hashed, F.array().cast("array<bigint>")).alias("t"))
    kinds = dict(rows.dtypes)
    return written(rows.mapInArrow(count, f"doc_id {kinds['doc_id']}, chunk_no {kinds['chunk_no']}, tokens long, dl long, terms array<long>, tfs array<int>"))


def _hashed_weights(queries: DataFrame, lists: DataFrame) -> tuple[DataFrame, float]:
    """weights(query_id, term, weight) of the queries' hashed terms, written, and the chunks' average length."""
    stats = lists.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")).first()
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(F.transform(terms(F.col("text")), lambda t: F.xxhash64(t))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return written(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))), stats["avg_dl"] or 1.0


def _scored_round(lists: DataFrame, weights: DataFrame, norm, min_relative: float, min_score: float, slack: float, most: int | None) -> DataFrame:
    """``_near`` for one round's queries: every chunk's scores for them are summed in the task that reads the chunk."""
    got = weights.toArrow().sort_by([("term", "ascending")])
    coded = got.column("query_id").combine_chunks().dictionary_encode()
    known = got.column("term").to_numpy()
    names, starts = np.unique(known, return_index=True)
    sent = lists.sparkSession.sparkContext.broadcast((coded.dictionary, names, np.append(starts, len(known)), coded.indices.to_numpy().astype(np.int64), got.column("weight").to_numpy()))

    shown = ["doc_id", "chunk_no"] if most is None else ["doc_id", "chunk_no", "tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names, starts, query, weight = sent.value
        terms, n, best = pd.Index(names), len(queries), np.full(len(queries), min_score)
        if not n:
            return
        # The best of the chunks that are too large to be taken, and the best so far of the others, from small to large.
        large, whose, least = np.zeros(n), np.full(n, -1), np.zeros((TAKEN, n))
        ids: list[pa.RecordBatch] = []
        met = 0
        # Terms that many queries have are a matrix, the others lists.
        often = np.argsort(-np.diff(starts), kind="stable")[:DENSE]
        often = often[np.diff(starts)[often] * DENSE_SHARE >= n]
        row, dense = np.full(len(names), -1), np.zeros((len(often), n))
        for i, t in enumerate(often):
            row[t] = i
            dense[i, query[starts[t] : starts[t + 1]]] = weight[starts[t] : starts[t + 1]]
        step = max(1, PLACES // n)

        def scored(batch: pa.RecordBatch) -> np.ndarray:
            lengths = pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), lengths)
            term = terms.get_indexer(batch.column(4).flatten().to_numpy())
            adds = norm(batch.column(5).flatten().to_numpy(), np.repeat(batch.column(3).to_numpy(), lengths))
            of, adds, term = of[term >= 0], adds[term >= 0], term[term >= 0]
            held, matrix = np.zeros((batch.num_rows, len(dense))), row[term] >= 0
            held[of[matrix], row[term[matrix]]] = adds[matrix]
            scores, at = (held @ dense).ravel(), 0
            of, adds, term = of[~matrix], adds[~matrix], term[~matrix]
            pairs = starts[term + 1] - starts[term]
            upto = np.cumsum(pairs)
            while at < len(term):
                before = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + PLACES, side="right")))
                many = pairs[at:end]
                place = np.arange(many.sum()) + np.repeat(starts[term[at:end]] - (upto[at:end] - many - before), many)
                scores += np.bincount(np.repeat(of[at:end] * n, many) + query[place], weight[place] * np.repeat(adds[at:end], many), len(scores))
                at = end
            return scores.reshape(batch.num_rows, n)

        def rows(batch: pa.RecordBatch, chunk: np.ndarray, q: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), *batch.select(shown).take(pa.array(chunk)).columns, pa.array(part)], ["query_id", *shown, "part"])

        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            scores = scored(batch)
            fits = np.ones(len(scores), bool) if most is None else batch.column(2).to_numpy() <= most
            if not fits.all():  # these come first
                own = scores[~fits] if fits.any() else scores
                highest = own.max(axis=0)
                more = np.flatnonzero(highest > large)
                large[more], whose[more] = highest[more], met + np.flatnonzero(~fits)[own[:, more].argmax(axis=0)]
                np.maximum(best, large, out=best)
            if most is not None:
                ids.append(batch.select(shown))
                met += len(scores)
            if fits.any():
                own = scores if fits.all() else scores[fits]
                np.maximum(best, own.max(axis=0), out=best)
                chunk, q = np.nonzero(own >= np.maximum(np.maximum(best * min_relative, least[0]) - slack, np.nextafter(0, 1)))
                yield rows(batch, np.flatnonzero(fits)[chunk], q, own[chunk, q])
                if most is not None:
                    some = np.unique(q)
                    held = np.concatenate([least[:, some], own[:, some]])
                    least[:, some] = np.sort(np.partition(held, len(own), axis=0)[len(own) :], axis=0)
        q = np.flatnonzero((whose >= 0) & (large >= best - slack))  # else a smaller chunk is better
        if len(q):
            taken = pa.Table.from_batches(ids).take(pa.array(whose[q])).combine_chunks().to_batches()[0]
            yield rows(taken, np.arange(len(q)), q, large[q])

    kinds = dict(lists.dtypes) | dict(weights.dtypes)
    if most is not None:
        # Each task passes on its own best, so few tasks leave less to shuffle.
        lists = lists.coalesce(lists.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(F.when(F.col("tokens") > most, -1).otherwise(F.col("tokens")))
    return lists.mapInArrow(read, ", ".join([*(f"`{c}` {kinds[c]}" for c in ("query_id", *shown)), "part double"]))


def near_candidates(postings: DataFrame, weights: DataFrame, min_relative: float, min_score: float) -> DataFrame:
    """``_near`` for postings(term, doc_id, chunk_no, norm)."""
    zero = F.lit(0).cast("long")
    lists = postings.groupBy("doc_id", "chunk_no").agg(F.first(zero).alias("tokens"), F.first(zero).alias("dl"), F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("norm").alias("tfs"))
    return _near(written(lists), weights.select("query_id", F.xxhash64("term").alias("term"), "weight"), lambda norm, dl: norm, min_relative, min_score)


def _near(lists: DataFrame, weights: DataFrame, norm, min_relative: float, min_score: float, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_no, part): the chunks that are near a query's best, with their whole scores.

    A chunk's terms are one row, and rounds of queries are sent to the tasks that read them, so no pair of a query and a chunk
    is shuffled but those near the best that its task has seen. Every query meets every chunk; memory is bounded by the round.
    With ``most``, only chunks that can be packed: of at most so many tokens, and with fewer than TAKEN better ones that are no
    larger, as those would be taken before them; and one best chunk of any size. ``norm(tf, dl)`` is what a term of weight 1 adds."""
    slack = 2e-6  # of scores that are rounded to 6 places
    sizes = weights.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("terms")).first()
    rounds = max(1, -(-sizes["queries"] // ROUND_QUERIES), -(-sizes["terms"] // ROUND_TERMS))
    dealt = weights.withColumn("round", F.pmod(F.xxhash64("query_id"), F.lit(rounds)))
    found = reduce(DataFrame.union, (_scored_round(lists, dealt.where(F.col("round") == r).select("query_id", "term", "weight"), norm, min_relative, min_score, slack, most) for r in range(rounds)))
    bar = F.greatest(F.max("part").over(W.partitionBy("query_id")), F.lit(min_score)) * min_relative - slack
    return found.withColumn("bar", bar).where(F.col("part") >= F.col("bar")).drop("bar")


def bm25_near(queries: DataFrame, chunks: DataFrame, min_relative: float = 0.6, min_score: float = 2.0, k1: float = 1.4, b: float = 0.75, most: int | None = None) -> DataFrame:
    """The rows of ``bm25_search`` whose score is at least ``min_relative`` of their query's best, of queries whose best is at least ``min_score``.

    Only scores near the best are kept, see ``_near``; ranks are those of the full search. With ``most`` only what ``pack_chunks`` can
    take of chunks up to so many tokens, and the best: ranks then are among these rows, in the same order, and ``tokens`` is a further column."""
    lists = _lists(chunks, F.lit(0) if most is None else F.col("tokens"))
    weights, avg_dl = _hashed_weights(queries, lists)
    norm = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))
    found = _near(lists, weights, norm, min_relative, min_score, most)
    scored = found.withColumn("score", F.round("part", 6)).drop("part").where("score > 0")
    top = F.max("score").over(W.partitionBy("query_id"))
    near = scored.withColumn("top", top).where((F.col("top") >= min_score) & (F.col("score") >= F.round(F.col("top") * min_relative, 6))).drop("top")
    return _ranked(near)


def pack_chunks(ranked: DataFrame, chunks: DataFrame, budget: int | DataFrame, min_relative: float = 0.6, max_chunks: int = TAKEN, min_score: float = 2.0) -> DataFrame:
    """(query_id, doc_id, chunk_no, score, tokens, pick): greedy by rank, skipping chunks that do not fit.

    Nothing when the best score is under ``min_score``; chunks under ``min_relative`` of it are out. The budget is one for
    all, or a frame (query_id, allowed) whose further columns tell several budgets of a query apart and are kept."""
    top = F.max("score").over(W.partitionBy("query_id"))
    near = ranked.withColumn("top", top).where((F.col("top") >= min_score) & (F.col("score") >= F.round(F.col("top") * min_relative, 6)))
    # Room never grows, so of chunks of one size only the first ``max_chunks`` can be taken: lists are as long as sizes are many.
    sized = near if "tokens" in near.columns else near.join(chunks.select("doc_id", "chunk_no", "tokens"), ["doc_id", "chunk_no"])
    sized = sized.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "tokens").orderBy("rank"))).where(F.col("nth") <= max_chunks)
    keys = ["query_id"]
    if isinstance(budget, int):
        sized = sized.withColumn("allowed", F.lit(budget))
    else:
        keys = [c for c in budget.columns if c != "allowed"]
        sized = sized.join(budget, "query_id")
    # A chunk over the budget is never taken, so it is dropped before lists are made.
    sized = sized.where(F.col("tokens") + WRAPPER <= F.col("allowed"))
    lists = sized.groupBy(*keys, "allowed").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_no", "score", "tokens"))).alias("ranked"))
    picked = lists.select(*keys, F.posexplode(greedy_skip(F.col("ranked"), lambda x: x["tokens"] + WRAPPER, F.col("allowed"), F.lit(0), max_chunks)).alias("pick", "c"))
    return picked.select(*keys, "c.doc_id", "c.chunk_no", "c.score", "c.tokens", (F.col("pick") + 1).cast("long").alias("pick"))


def head_documents(docs: DataFrame, budget: int, sep: str = "\n\n", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose chunks ``prefill_documents`` can take from ``budget``, so that only they are cut into chunks.

    It looks at the first budget / WRAPPER + 1 chunks; a document with a paragraph has at least one, so they are chunks of so many first
    documents with a paragraph. Every document is read for that, and no other is counted."""
    some = F.exists(F.split(F.coalesce(text, F.lit("")), sep), lambda p: strip(p) != "")
    # Written, as else counting is pushed below the limit and all texts are sorted for it.
    return written(docs.where(some).orderBy(doc_id).limit(budget // WRAPPER + 1))


def prefill_documents(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks in stored order up to the first that does not fit, with the running cost.

    Every chunk costs at least WRAPPER, so only the first budget / WRAPPER chunks can matter: a
    distributed top-k, exact, and the running sum is over that many rows at most."""
    cost = F.col("tokens") + WRAPPER
    head = chunks.orderBy("doc_id", "chunk_no").limit(budget // WRAPPER + 1)
    running = F.sum(cost).over(W.orderBy("doc_id", "chunk_no").rowsBetween(W.unboundedPreceding, 0))
    return head.withColumn("running", running).where(F.col("running") <= budget)
