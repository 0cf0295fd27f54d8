"""Line de-duplication by site-relative frequency.

Documents are grouped by host; a line's ratio is the number of the host's documents that hold it
divided by the host's documents. Lines above the boilerplate ratio are dropped. Native functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: The drop list is broadcast only while it has at most this many lines; beyond, the join is shuffled.
BROADCAST_LINES = 200_000


def _line_key(line: Column) -> Column:
    return F.md5(F.trim(line))


def drop_boilerplate_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_docs: int = 5
) -> DataFrame:
    """Replaces the text by its kept lines and adds ``n_lines``, ``n_dropped``.

    A line (compared without blanks at either end) goes when it stands in at least ``min_docs``
    documents of the host and in more than ``max_ratio`` of them; every occurrence goes. Blank lines are
    never counted or dropped. All lines of a page may go, which leaves an empty text.

    Null texts stay null with 0 lines; a null host is a host of its own; repeated rows count as
    documents each; columns named ``n_lines`` or ``n_dropped`` are replaced. At most
    mean-lines-per-document / ``max_ratio`` lines of a host can exceed the ratio, so the drop
    list that is gathered for each host is bounded however large the host is.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n"))
    lines = F.split(F.col(text_col), "\n")
    held = docs.select(
        host.alias("h"),
        F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _line_key))).alias("k"),
    )
    counts = held.groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    totals = docs.select(host.alias("h")).groupBy("h").agg(F.count("*").alias("total"))
    frequent = (
        counts.join(totals, "h")
        .where(F.col("n") > F.col("total") * F.lit(max_ratio))
        .groupBy("h")
        .agg(F.collect_set("k").alias("drop_keys"))
    )
    key, keys, kept = fresh(docs, "host_key"), fresh(docs, "drop_keys"), fresh(docs, "kept_lines")
    frequent = materialise(frequent.select(F.col("h").alias(key), F.col("drop_keys").alias(keys)))
    if (frequent.agg(F.sum(F.size(keys))).first()[0] or 0) <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    joined = docs.withColumn(key, host).join(frequent, key, "left").withColumn(keys, F.coalesce(F.col(keys), F.array().cast("array<string>")))
    joined = joined.withColumn(kept, F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), _line_key(x))))
    n = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    return joined.select(
        *[F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n.alias("n_lines"),
        (n - F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(kept)), F.lit(0))).cast("long").alias("n_dropped"),
    )
