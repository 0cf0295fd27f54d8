"""Order-dependent folds over arrays inside a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spelled as types, not as DDL: workers import this module without a session.
NEXT_FIT = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("tokens", T.LongType())]))


def next_fit_bounds(tokens: np.ndarray, cap: float) -> list[dict]:
    """Bins of consecutive items; a new one starts when the next item no longer fits.

    An item above the cap is a bin of its own, unless small ones cannot follow it. Bins are found
    by searching the running sum, one step for each bin."""
    out, at, total = [], 0, np.concatenate([[0], np.cumsum(tokens)])
    while at < len(tokens):
        end = max(at + 1, int(np.searchsorted(total, total[at] + cap, side="right")) - 1)
        out.append({"first": at, "n": end - at, "tokens": int(total[end] - total[at])})
        at = end
    return out


@F.pandas_udf(NEXT_FIT)
def _next_fit(tokens: pd.Series, cap: pd.Series) -> pd.Series:
    return pd.Series([next_fit_bounds(np.asarray(t, np.int64), c) for t, c in zip(tokens, cap, strict=True)], dtype=object)


def next_fit(tokens: Column, cap: Column | int) -> Column:
    """(first, n, tokens) of each bin over an ``array<long>``; ``first`` counts from 0."""
    return _next_fit(tokens, (F.lit(cap) if isinstance(cap, int) else cap).cast("long"))


def greedy_skip(items: Column, cost, budget: Column, start: Column, most: int | None = None) -> Column:
    """Keeps items in order while they fit, skipping those that do not; ``cost`` is a function of an item.

    ``items`` is an array of structs in the order of preference; returns the kept ones."""

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + cost(x) <= budget
        if most is not None:
            fits = fits & (F.size(state["kept"]) < most)
        return F.when(fits, F.struct((state["used"] + cost(x)).alias("used"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state)

    # The empty array takes its type from the items.
    empty = F.filter(items, lambda x: F.lit(False))
    return F.aggregate(items, F.struct(start.cast("long").alias("used"), empty.alias("kept")), step, lambda s: s["kept"])
