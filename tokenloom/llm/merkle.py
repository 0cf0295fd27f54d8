"""Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf of its group's tree and has a rank there; the groups' roots are the leaves of one more tree, in
the groups' order, whose root is the dataset's. A node of level l carries the interval [lo, hi) of leaf ranks that it
covers, so it lies in bucket lo / FAN^(l+1) of its parent's level: a join on tree and bucket, with one interval inside
the other, attaches a node to its parent, and those of the parent's children whose intervals lie before or after
the node's own are its siblings. Paths are handed down level by level, from few nodes to many, so a join key never has more
than FAN rows on its larger side, however large a group is.

Ranks come from one sort by range of all rows and the row counts of its partitions; no group is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Children of a node.
FAN = 16
#: Counts of partitions are broadcast only up to so many.
BROADCAST_PARTS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def path_digest(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf's level upwards, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 in the order within ``tree``, and ``n``, the tree's rows; nulls come first."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = materialise(placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows")))
    # A tree has at most a row for each partition here.
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")))
    small = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    return placed.join(small, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """(tree, n, lo, hi, digest, children) of each level from 1 on, of ``leaves(tree, n, rank, digest)``.

    ``children`` has the intervals and digests of at most FAN nodes. A tree ends at the level that has one node. A lone leaf
    is its tree's root: its level 1 hands its digest on."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    found, span = [], FAN
    while True:
        children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        grouped = nodes.groupBy("tree", "n", F.floor(F.col("lo") / span).alias("bucket")).agg(children.alias("children"))
        own = digest(F.concat_ws("", F.col("children.digest")))
        own = F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(own)
        nodes = materialise(grouped.select("tree", "n", F.col("children")[0]["lo"].alias("lo"), F.array_max("children.hi").alias("hi"), own.alias("digest"), "children"))
        found.append(nodes)
        if span >= most:
            return found
        nodes, span = nodes.where(F.col("n") > span).drop("children"), span * FAN


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the level that has a tree's one node."""
    tops = [nodes.where(F.col("n") <= FAN ** (i + 1)).select("tree", "digest") for i, nodes in enumerate(found)]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out


def _step(lo: Column, hi: Column, children: Column) -> Column:
    """A node's siblings: those children of its parent whose intervals end before its own or begin after it."""
    left = F.filter(children, lambda c: c["hi"] <= lo)
    right = F.filter(children, lambda c: c["lo"] >= hi)
    return F.array(F.struct(*[F.concat_ws("", F.transform(side, lambda c: c["digest"])).alias(name) for name, side in (("left", left), ("right", right))]))


def _within(inner: DataFrame, outer: DataFrame, span: int) -> DataFrame:
    """Nodes (or leaves) with the parent whose interval contains theirs; parents' columns are named ``p_``."""
    outer = outer.select(*[F.col(c).alias(f"p_{c}") for c in outer.columns])
    bucket = F.floor(F.col("lo") / span) == F.floor(F.col("p_lo") / span)
    contained = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    return inner.join(outer, (F.col("tree") == F.col("p_tree")) & bucket & contained)


def paths(leaves: DataFrame, found: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``leaves`` with subroot and path; ``above(tree, up)`` has the paths from the trees' roots on."""
    attached = None
    for i in range(len(found) - 1, -1, -1):
        span = FAN ** (i + 1)
        nodes = found[i].withColumnRenamed("digest", "own")
        tops = nodes.where(F.col("n") <= span)
        tops = tops.join(above, "tree") if above is not None else tops.withColumn("up", F.array().cast(_PATH))
        tops = tops.select("tree", "n", "lo", "hi", "children", F.col("own").alias("subroot"), "up")
        if attached is not None:
            below = _within(nodes.where(F.col("n") > span), attached, span * FAN)
            up = F.concat(_step(F.col("lo"), F.col("hi"), F.col("p_children")), F.col("p_up"))
            tops = tops.unionByName(below.select("tree", "n", "lo", "hi", "children", F.col("p_subroot").alias("subroot"), up.alias("up")))
        attached = tops
    bounds = leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)
    joined = _within(bounds, attached.drop("n"), FAN)
    path = F.when(F.col("n") == 1, F.col("p_up")).otherwise(F.concat(_step(F.col("lo"), F.col("hi"), F.col("p_children")), F.col("p_up")))
    return joined.select(*leaves.columns, F.col("p_subroot").alias("subroot"), path.alias("path"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, leaf, claim, subroot, root, path) of every row.

    ``leaf`` is the digest of the row's fields, ``subroot`` that of its group, ``root`` that of the dataset; ``path`` has
    the siblings (left, right) of each level from the leaf up to the root. ``claims`` has other values for some fields: ``claim``
    is the leaf that they give, so that ``folded(claim, path) = root`` tells whether the row is as it was.

    Rows of a group ascend by id, null first; rows that repeat an id are ordered by leaf, then claim, and equal rows, which have a leaf
    each, take the places between. Rows without a group are one group, the first. Null fields are ``-``, empty texts ``0:``. An
    empty table gives no rows; columns other than ``fields`` do not count.
    """
    claims = claims or {}
    value = {c: docs[c] for c in fields}
    leaf = digest(F.concat(*[field(value[c]) for c in fields]))
    claim = digest(F.concat(*[field(claims.get(c, value[c])) for c in fields])) if claims else leaf
    # A letter before the name sets a missing group apart from an empty one, and before it.
    tree = F.when(docs[group_col].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs[group_col].cast("string")))
    # Written before they are sorted by range, which reads its input twice; the number deals out rows that are equal.
    rows = materialise(docs.select(tree.alias("tree"), docs[id_col].alias("id"), leaf.alias("digest"), claim.alias("claim"), F.monotonically_increasing_id().alias("number")))
    leaves = materialise(ranked(rows, ["id", "digest", "claim", "number"]).drop("number"))
    found = levels(leaves)
    tops = ranked(materialise(roots(found).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")), ["name"])
    tops = materialise(tops)
    above = paths(tops, levels(tops)).select(F.col("name").alias("tree"), F.col("path").alias("up"), F.col("subroot").alias("root"))
    above = materialise(above)
    rows = paths(leaves, found, above.select("tree", "up"))
    root = F.broadcast(above.select("root").limit(1))
    return rows.crossJoin(root).select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "claim", "subroot", "root", "path")
