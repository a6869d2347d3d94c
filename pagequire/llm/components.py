"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for each id that is not the smallest itself, by union-find."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(ids.size))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(at[: u.size].tolist(), at[u.size :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)  # positions follow ids, so the smallest id stays the root
    roots = np.array([root(x) for x in range(ids.size)], np.int64)
    moved = np.flatnonzero(roots != np.arange(ids.size))
    return ids[moved], ids[roots[moved]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) with the same components: each part of them becomes stars around its local components' smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            u, v = _forest(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
            yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    return edges.repartition(parts).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, part: int = 1 << 18, rounds: int = 60) -> DataFrame:
    """(id, root) for each id in `edges(a, b)`: root is the smallest id that a path reaches.

    Parts of at most about `part` edges are contracted by themselves first; if they fit into one, that is the result.
    Then large-star steps (larger neighbours move to the smallest neighbour) and small-star steps (smaller ones do)
    alternate until the edges no longer change; their number grows with the logarithm of the longest path. Each step
    takes a minimum by id, which is summed up before the shuffle, and a join back, whose hot ids Spark may split.
    Nulls and loops are ignored; an empty table gives an empty one. Too few rounds raise an error.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    parts = max(1, -(-e.count() // part))
    e = cut(_contracted(e, parts))
    seen = None
    for _ in range(rounds if parts > 1 else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.filter("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        if parts > 1:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
