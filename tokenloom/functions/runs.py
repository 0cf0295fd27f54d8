"""Which pages hold which runs of words: runs by rolling hashes, kept only where a bit map says that someone looks for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of runs; a phrase is looked for by its longest that it has.
RUNS = (12, 6, 3, 2, 1)
#: The bit map has about 16 bits a run, from 2 ** 20 to 2 ** 28 (32 MB): beyond, it lets more through, but loses nothing.
LEAST_BITS, MOST_BITS = 20, 28
#: Pages that a task reads at once.
SLICE = 500
#: Bits in a row of Spark's bit maps.
BUCKET = 1 << 15


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _keys(flat: np.ndarray, n: int) -> np.ndarray:
    """A key for the run of ``n`` words at every place of ``flat`` from which so many are left."""
    flat, at = flat.view(np.uint64), len(flat) - n + 1
    key = np.full(max(at, 0), n, np.uint64)
    for j in range(n if at > 0 else 0):
        key = key * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + at]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


@F.pandas_udf(T.LongType())
def _run_key(words: pd.Series) -> pd.Series:
    return pd.Series([int(_keys(np.asarray(w, np.int64), len(w))[0]) for w in words], dtype="int64")


def run_key(words: Column) -> tuple[Column, Column]:
    """Whether ``words`` (at least one) are enough for a run, and the key of their first ones, as many as the longest length that they have."""
    n = F.coalesce(*[F.when(F.size(words) >= k, F.lit(k)) for k in RUNS])
    return F.size(words) > 0, _run_key(hashed(F.slice(words, F.lit(1), n)))


def bit_map(keys: DataFrame, key: str = "key") -> tuple[np.ndarray, int]:
    """One bit for the highest bits of each key; its size is bounded, whatever the number of keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned(key, 64 - bits) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        low = (r["b"] - 1) * BUCKET // 8
        table[low : low + BUCKET // 8] = np.frombuffer(r["m"], np.uint8)
    return table, bits


def runs_held(pages: DataFrame, words: str, keys: DataFrame) -> DataFrame:
    """The other columns of ``pages`` with the ``key`` of each run of their ``words`` that may be among ``keys(key)``."""
    rest = [c for c in pages.columns if c != words]
    sent = pages.sparkSession.sparkContext.broadcast(bit_map(keys))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = sent.value
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            held = batch.column(len(rest))
            ends = np.cumsum(pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            rows, found = [], []
            for n in RUNS:
                key = _keys(flat, n)
                place = key.view(np.uint64) >> np.uint64(64 - bits)
                at = np.flatnonzero((table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                row = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[row]  # a run does not go on in the next row
                rows.append(row[inside])
                found.append(key[at[inside]])
            row, key = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][: len(row)]
            taken = batch.select(rest).take(pa.array(row[new], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(key[new], pa.int64())], [*rest, "key"])

    kinds = dict(pages.dtypes)
    return pages.select(*rest, hashed(F.col(words)).alias(words)).mapInArrow(read, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "key long"]))
