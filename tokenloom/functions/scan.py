"""Sums over all rows before a row, and next-fit over long lists, by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import small, written


def sums_before(rows: DataFrame, key: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, for each ``values[name]``, the sum of that column over the key's earlier rows as ``name``.

    Rows are dealt to blocks by range of key and order, so a block is one partition however many rows a key has; sums of
    blocks give each block's start, and only inside a block is there a running sum. Rows with equal key and order stay in one block."""
    by = [F.col(c).asc_nulls_first() for c in (*key, *order)]
    placed = written(rows.repartitionByRange(*by).withColumn("scan_block", F.spark_partition_id()))
    blocks = placed.groupBy(*key, "scan_block").agg(*[F.sum(v).alias(f"scan_{n}") for n, v in values.items()])
    earlier = W.partitionBy(*key).orderBy("scan_block").rowsBetween(W.unboundedPreceding, -1)
    starts = written(blocks.select(*key, "scan_block", *[F.coalesce(F.sum(f"scan_{n}").over(earlier), F.lit(0)).alias(f"scan_{n}") for n in values]))
    inside = W.partitionBy(*key, "scan_block").orderBy(*by[len(key):]).rowsBetween(W.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in values.items()])
    starts = small(starts).select(*[F.col(c).alias(f"scan_key{i}") for i, c in enumerate(key)], F.col("scan_block").alias("scan_of"), *[f"scan_{n}" for n in values])
    same = F.col("scan_block") == F.col("scan_of")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"scan_key{i}"))
    return local.join(starts, same).select(*rows.columns, *[(F.col(n) + F.col(f"scan_{n}")).alias(n) for n in values])


#: Places of a list that one task walks.
WALK = 4096


def next_fit_bins(rows: DataFrame, key: list[str], order: list[str], size: str, cap: str, walk: int = WALK) -> DataFrame:
    """(*key, first, n, tokens) of the bins that next-fit makes of each key's rows in order; ``first`` counts from 0.

    A bin takes rows while their sizes fit ``cap`` (the same in all rows of a key), and at least one. Where the bin that begins at a row
    would end is found for every row at once: rows' running sums and the sums that bins may reach are put in one order, and the
    running count of the former tells how many rows fit. These pointers are followed inside blocks of ``walk`` places;
    from block to block, the places where blocks are entered double their steps until all bins of the list are known. No task has more than a block."""
    at = "place"
    rows = rows.select(*key, *order, F.col(size).cast("long").alias("size"), F.col(cap).cast("long").alias("cap"), F.lit(1).cast("long").alias("one"))
    placed = written(sums_before(rows, key, order, {at: "one", "before": "size"}).select(*key, at, "before", "size", "cap"))
    ends = placed.select(*key, (F.col("before") + F.col("size")).alias("sum"), F.lit(0).alias("kind"), at, "before", F.lit(1).cast("long").alias("one"), "size")
    goals = placed.select(*key, (F.col("before") + F.col("cap")).alias("sum"), F.lit(1).alias("kind"), at, "before", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("size"))
    met = sums_before(ends.unionByName(goals), key, ["sum", "kind", at], {"fit": "one", "total": "size"}).where("kind = 1")
    alone = F.col("fit") <= F.col(at)  # a row over the cap is a bin of its own
    own = placed.select(*key, at, F.col("size").alias("own"))
    hops = met.select(*key, at, "before", "fit", "total").join(own, [*key, at]).select(
        *key, at, F.when(alone, F.col(at) + 1).otherwise(F.col("fit")).alias("next"), F.when(alone, F.col("own")).otherwise(F.col("total") - F.col("before")).alias("tokens"), F.floor(F.col(at) / walk).alias("block")
    )
    hops = written(hops)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def leave(block: pd.DataFrame) -> pd.DataFrame:
        """Where the walk from each place leaves the block; from the last place to the first."""
        block = block.sort_values(at, ignore_index=True)
        low, out = int(block[at].iloc[0]), block["next"].to_numpy().copy()
        for i in range(len(out) - 1, -1, -1):
            if out[i] - low < len(out):
                out[i] = out[out[i] - low]
        return block[[*key]].assign(place=block[at], leaves=out)

    left = written(hops.groupBy(*key, "block").applyInPandas(leave, f"{schema}, place long, leaves long"))
    # Only places where a walk enters a block from another one are followed further.
    entered = left.where("place = 0").select(*key, at).union(left.select(*key, "leaves")).distinct()
    jumps = written(left.join(entered, [*key, at], "left_semi"))
    reached = jumps.where("place = 0").select(*key, at)
    while True:
        more = reached.join(jumps, [*key, at]).select(*key, F.col("leaves").alias(at)).join(jumps, [*key, at], "left_semi")
        more = written(more.join(reached, [*key, at], "left_anti").distinct())
        if not more.limit(1).count():
            break
        reached = written(reached.union(more))
        further = jumps.select(*key, F.col(at).alias("leaves"), F.col("leaves").alias("then"))
        jumps = written(jumps.join(further, [*key, "leaves"], "left").select(*key, at, F.coalesce("then", "leaves").alias("leaves")))

    def bins(block: pd.DataFrame) -> pd.DataFrame:
        """The bins that begin in a block, from where it is entered."""
        block = block.sort_values(at, ignore_index=True)
        low, nexts, firsts = int(block[at].iloc[0]), block["next"].to_numpy(), []
        i = int(np.argmax(block["entry"].to_numpy()))
        while i < len(nexts):
            firsts.append(i)
            i = int(nexts[i]) - low
        found = block.iloc[firsts]
        return found[[*key]].assign(first=found[at], n=found["next"] - found[at], tokens=found["tokens"])

    marked = hops.join(reached.withColumn("entry", F.lit(True)), [*key, at], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    crossed = reached.select(*key, F.floor(F.col(at) / walk).alias("block")).distinct()
    return marked.join(crossed, [*key, "block"], "left_semi").groupBy(*key, "block").applyInPandas(bins, f"{schema}, first long, n long, tokens long")
