"""A Merkle manifest of a dataset: every row's digest, a root over all of them, and each row's proof.

Rows of a group are numbered in order, and every `fanout` nodes have a parent. A pivot spreads the nodes below one
ancestor into slot columns by conditional aggregates; hashing the concatenation of a parent's columns makes the parent,
and the columns without a node's own are its siblings. A pivot takes `levels` levels at a time, so that rows and their
proofs are shuffled once for several levels. What is above a node comes down from the pivots above, joined by ancestor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import laid, numbered
from .store import cut


def field(value: Column) -> Column:
    """How a value enters a digest: its length in UTF-8 bytes, a colon and itself; `-` if it is null."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(parts: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def _text(side: Column) -> Column:
    """Digests that are kept as bytes, as the hex text that is hashed."""
    return F.lower(F.hex(side))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path(left, right), from the node up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s.left), _text(s.right))), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_text(s.left), h, _text(s.right)), 256))


def _up(nodes: DataFrame, counts: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the nodes up, tops(g, h)) of nodes(g, i, node<h, ...>), numbered from 0 in their group g, and counts(g, n)."""
    slots = fanout**levels
    most = counts.agg(F.max("n")).first()[0] or 0
    pivots, rows = [], nodes
    while not pivots or most > 1:
        own = F.col("i") % slots
        wide = rows.withColumn("up", F.floor(F.col("i") / slots).cast("long")).groupBy("g", "up").agg(*[F.max(F.when(own == s, F.col("node"))).alias(f"v0_{s}") for s in range(slots)])
        # only a group's first node can be its last one; others have a neighbour, whatever their number
        pivots.append(cut(wide.join(counts.select("g", F.lit(0).cast("long").alias("up"), "n"), ["g", "up"], "left")))
        rows = _parents(pivots[-1], fanout, levels).select("g", F.col("up").alias("i"), F.struct(F.col(f"v{levels}_0").alias("h")).alias("node"))
        counts = counts.withColumn("n", F.ceil(F.col("n") / slots).cast("long"))
        most = -(-most // slots)
    return pivots, rows.select("g", F.col("node.h").alias("h"))


def _down(pivots: list[DataFrame], over: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(node, path, ...) of all nodes below the pivots; over(g, path, ...): what stands over each group's top."""
    slots, paths = fanout**levels, over.withColumn("i", F.lit(0).cast("long"))
    rest = [c for c in over.columns if c not in ("g", "path")]
    for depth, wide in reversed(list(enumerate(pivots))):
        met = _parents(wide, fanout, levels).join(paths.withColumnRenamed("i", "up"), ["g", "up"])
        below = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"v0_{s}").alias("node"), F.array_compact(F.array(*_steps(s, fanout, levels))).alias("steps")) for s in range(slots)])
        each = met.select("g", "up", "path", *rest, F.explode(F.filter(below, lambda c: c.node.isNotNull())).alias("c"))
        paths = each.select("g", (F.col("up") * slots + F.col("c.slot")).alias("i"), *[F.col("c.node").alias("node")] * (depth == 0), F.concat("c.steps", "path").alias("path"), *rest)
    return paths


def _alone(level: int, fanout: int) -> Column:
    """Whether a group has a single node so many levels above a pivot's slots: it is the top, and is not hashed again."""
    return F.coalesce(F.col("n") <= fanout**level, F.lit(False))


def _parents(wide: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A pivot with columns of its parents: v<level>_<place>, null where there is no node below."""
    hashed = lambda level, s: F.col(f"v0_{s}.h") if level == 0 else F.col(f"v{level}_{s}")
    for level in range(levels):
        made = {}
        for p in range(fanout ** (levels - level - 1)):
            below = [hashed(level, s) for s in range(p * fanout, (p + 1) * fanout)]
            node = F.when(below[0].isNotNull(), digest([F.coalesce(b, F.lit("")) for b in below]))
            made[f"v{level + 1}_{p}"] = F.when(_alone(level, fanout), below[0]).otherwise(node) if p == 0 else node
        wide = wide.withColumns(made)
    return wide


def _steps(slot: int, fanout: int, levels: int) -> list[Column]:
    """What stands beside a slot's ancestors, level by level: the columns of their parents without their own."""
    out = []
    for level in range(levels):
        own = slot // fanout**level
        first = own - own % fanout
        other = lambda ss: F.unhex(F.concat(F.lit(""), *[F.coalesce(F.col(f"v0_{s}.h" if level == 0 else f"v{level}_{s}"), F.lit("")) for s in ss]))  # noqa: B023, E731
        out.append(F.when(~_alone(level, fanout), F.struct(other(range(first, own)).alias("left"), other(range(own + 1, first + fanout)).alias("right"))))
    return out


def manifest(leaves: DataFrame, fanout: int = 2, levels: int = 2) -> DataFrame:
    """`leaves(grp, key, leaf, ...)` with subroot, root and path<left, right>, the siblings of the leaf's ancestors as bytes.

    Per grp (a string; null is a group of its own), leaves ascend by key, nulls first, then by leaf, so equal rows share
    their places' values. Every `fanout` nodes in turn have a parent, the last one maybe fewer, until one is left: the
    subroot. Subroots in order of grp, null first, else by UTF-8 bytes, lead likewise to the root. Rows are numbered over
    range partitions, so a group of any size is split among tasks, and no text is needed here: a leaf is 64 characters.
    An empty table gives an empty one. Columns that are not named above come back unchanged but for those of the result.
    """
    rest = [c for c in leaves.columns if c.lower() not in ("grp", "key", "leaf", "subroot", "root", "path")]
    named = F.when(F.col("grp").isNull(), "").otherwise(F.concat(F.lit("="), F.col("grp"))).alias("g")
    rows = cut(leaves.select(named, F.col("key"), F.col("leaf"), F.struct(F.col("leaf").alias("h"), "grp", "key", *rest).alias("node")))
    rows = cut(numbered(laid(rows, ["g"], ["key", "leaf"]), ["g"], "i").select("g", "i", "node"))
    counts = cut(rows.groupBy("g").agg(F.max("i").alias("n")).withColumn("n", F.col("n") + 1))
    pivots, tops = _up(rows, counts, fanout, levels)
    tops = laid(cut(tops).withColumn("all", F.lit("")), ["all"], ["g"])
    tops = cut(numbered(tops, ["all"], "i").select(F.col("all").alias("g"), "i", F.struct("h", F.col("g").alias("group")).alias("node")))
    groups, root = _up(tops, tops.groupBy("g").agg(F.count("*").alias("n")), fanout, levels)
    root = root.first()
    none = F.expr("cast(array() as array<struct<left: binary, right: binary>>)")
    over = _down(groups, tops.select("g", none.alias("path")).distinct(), fanout, levels)
    over = cut(over.select(F.col("node.group").alias("g"), "path", F.col("node.h").alias("subroot")))
    placed = _down(pivots, over, fanout, levels)
    return placed.select(*[F.col(f"node.{c}").alias(c) for c in ("grp", "key", *rest)], F.col("node.h").alias("leaf"), "subroot", F.lit(root and root["h"]).cast("string").alias("root"), "path")
