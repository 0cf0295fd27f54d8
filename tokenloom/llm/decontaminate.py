"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item's windows (``window`` consecutive words, or the whole item where it is shorter) are sets
of positioned word shingles. One pass over the corpus counts them; for full containment one
shingle, the rarest, is a sufficient prefix, and a window with a shingle that no text holds is out. A second
pass joins the corpus to the prefixes alone, under position and length bounds. The candidate texts are then
read once more, and a window counts where its words stand, word for word. Native DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialise

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 5
#: Item shingles are broadcast only up to this many; beyond, the join is shuffled.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """The words of a text in order; splitting costs a tenth of extracting every match."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _shingles(tokens: Column, size: int) -> Column:
    """(pos, shingle) for every run of ``size`` words, positions from 0; shingles as hashes, as windows are verified word for word."""
    n = F.size(tokens)
    return F.when(
        n >= size,
        F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(tokens, i + k) for k in range(size)], F.lit(size)).alias("shingle")),
        ),
    )


def _small(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """The frame, written once and marked for broadcast if its summed weight (rows by default) is small enough."""
    df = materialise(df)
    total = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_SHINGLES else df


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """Adds ``n_words, n_hit, n_items, items_sha256, contaminated`` to every row of ``docs``.

    A document word inside any occurrence of a window is hit; ``n_items`` counts the items with an
    occurring window and ``items_sha256`` is over their ids, sorted as strings and comma-joined.
    Null or wordless texts have no words and no hits; items without words have no windows; items
    with a null id hit words but are not listed; repeated rows keep their row each; empty tables
    give no hits; columns of ``docs`` named like the new ones are replaced.
    """
    out_names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in out_names])
    item_words = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    windows = item_words.select(
        "item",
        F.explode(
            F.when(n < window, F.array(F.array_join("w", " "))).otherwise(
                F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.array_join(F.slice("w", i, window), " "))
            )
        ).alias("window"),
    ).distinct()
    windows = materialise(windows)
    tokens = F.split("window", " ")
    size = F.least(F.lit(SHINGLE), F.size(tokens))
    sizes = sorted(r[0] for r in windows.select(size.alias("s")).distinct().collect())
    parts = [
        windows.select("window").distinct().withColumn("len", F.size(tokens)).where(size == s).select("window", "len", F.explode(_shingles(tokens, s)).alias("x"), F.lit(s).alias("size"))
        for s in sizes
    ]
    text_key = F.md5(F.col(text_col))
    empty_hits = docs.sparkSession.createDataFrame([], "k string, n_hit long, items array<string>")
    hits = empty_hits
    if parts:
        placed = parts[0]
        for p in parts[1:]:
            placed = placed.unionByName(p)
        placed = materialise(placed.select("window", "len", "size", F.col("x.pos").alias("off"), F.col("x.shingle").alias("shingle")))

        def stream(column: Column, name: str) -> DataFrame:
            """(name, n, pos, shingle) of every run of words of every text.

            Shingles are made below the explode, which else copies a text's words into each of its rows;
            the outer form has no filter that would make them twice. Joins drop its null row.
            """
            doc_words = docs.select(column.alias(name), words(F.col(text_col)).alias("w"))
            runs = [
                doc_words.select(name, F.size("w").alias("n"), _shingles(F.col("w"), s).alias("runs")).select(name, "n", F.explode_outer("runs").alias("x"))
                for s in sizes
            ]
            found = runs[0]
            for r in runs[1:]:
                found = found.unionByName(r)
            return found.select(name, "n", F.col("x.pos").alias("pos"), F.col("x.shingle").alias("shingle"))

        rarity = materialise(stream(F.lit(0), "k").select("shingle").join(_small(placed.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("df")))
        # Windows with a shingle that stands nowhere are out; the rarest shingle is the prefix.
        ranked = placed.join(rarity, "shingle").groupBy("window", "len", "size").agg(F.count("*").alias("present"), F.min(F.struct("df", "shingle", "off")).alias("rarest"))
        whole = F.col("len") - F.col("size") + 1
        prefixes = ranked.where(F.col("present") == whole).select("len", F.col("rarest.shingle").alias("shingle"), F.col("rarest.off").alias("off")).distinct()
        start = F.col("pos") - F.col("off")
        candidates = (
            stream(text_key, "k").join(_small(prefixes), "shingle")
            .where((start >= 0) & (start + F.col("len") <= F.col("n")))
            .select("k", start.alias("start"), "len").distinct()
        )
        # A text's candidates are at most its positions for each length of window, and two numbers each.
        by_text = candidates.groupBy("k").agg(F.collect_list(F.struct("start", "len")).alias("found"))
        stands = F.transform("found", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["len"]).alias("end"), F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ").alias("window")))
        placed_words = (
            docs.select(text_key.alias("k"), F.col(text_col).alias("t")).join(_small(by_text, F.size("found")), "k")
            .select("k", "found", words(F.col("t")).alias("w"))
            .select("k", F.inline(stands)).distinct()
        )
        # The words that stand there are an item's window, or they are none.
        verified = materialise(placed_words.join(_small(windows.select("window").distinct()), "window", "left_semi").select("k", "window", "start", "end"))
        before = F.max("end").over(W.partitionBy("k").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
        spans = verified.select("k", "start", "end").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
        covered = spans.groupBy("k").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("before", "start"))).cast("long").alias("n_hit"))
        listed = (
            verified.select("k", "window").distinct()
            .join(_small(windows), "window")
            .where("item is not null")
            .select("k", "item").distinct()
            .groupBy("k").agg(F.collect_list("item").alias("items"))
        )
        hits = covered.join(listed, "k", "left").select("k", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        hits = _small(hits, F.size("items") + 1)
    key, listed_ids = fresh(docs, "text_key"), fresh(docs, "listed_items")
    hits = hits.select(F.col("k").alias(key), "n_hit", F.col("items").alias(listed_ids))
    ids = F.coalesce(F.col(listed_ids), F.array().cast("array<string>"))
    return (
        docs.withColumn(key, text_key)
        .join(hits, key, "left")
        .select(
            *docs.columns,
            F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, min_hit: int = 1, **names) -> DataFrame:
    """Keeps the rows with fewer than ``min_hit`` hit words, with their own columns."""
    judged = contamination(docs, items, **names)
    return judged.where(F.col("n_hit") < min_hit).select(*[judged[c] for c in docs.columns])
