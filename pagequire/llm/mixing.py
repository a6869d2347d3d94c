"""Mixing sources to target weights, with a splitting tree that deals exact source quotas to output shards.

Each source's texts are permuted by a seeded hash and cut into blocks. A source gives whole passes over its blocks and,
for the rest of its target, the first blocks of its permutation, the last of them in part. That makes a number of block
draws for each source. The tree halves the shards again and again; at each node the left half's share of every source's
draws follows the multivariate hypergeometric distribution, and the right half gets what remains, so no draw is lost or
made twice. Each shard then takes its own range of a source's permuted draws and is shuffled within itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Blocks, and ranges of a hash, that are numbered at a time.
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds target to `sizes(source, source_size)`, one row for each source.

    Sources take weights in the order of their names, null last, over and over. They share share * the sum of all sizes
    by weight; a target stops at most * its source's size and the excess is dealt to the others by weight again, until
    none is above: the one level at which the sum of min(limit, level * weight) is what is to be shared.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    full = rows.withColumn("goal", F.least(F.lit(float(share)) * F.sum("source_size").over(all_), F.sum("limit").over(all_)))
    filled = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = full.withColumn("level", (F.col("goal") - filled) / left)
    # up to some source all are full; the first that is not sets the level for the rest
    full = full.withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(all_).level
    return full.withColumn("target", F.coalesce(F.least("limit", level * F.col("weight")), F.col("limit"))).drop("limit", "goal", "level", "open")


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's draws each shard gets; rows differ by one draw in total at most."""
    if shards == 1:
        return quotas[None, :]
    total = int(quotas.sum())
    half = shards // 2
    # the left half's capacity: what its shards hold when all draws are dealt evenly, the first shards one more
    many, more = divmod(total, shards)
    room = half * many + min(half, more)
    left = np.zeros_like(quotas)
    rest = total
    for i, q in enumerate(quotas):  # the multivariate draw, a source at a time
        left[i] = rng.hypergeometric(int(q), int(rest - q), int(room)) if room and q else 0
        rest -= q
        room -= left[i]
    return np.concatenate([split(left, half, rng), split(quotas - left, shards - half, rng)])


def _numbered(rows: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows of the same keys that come before a row, chunk by chunk and in order within one.

    Chunks are summed up before they are shuffled and their sums run over one row for each, so no key's rows have to be
    in one task. Keys may be null.
    """
    rows = rows.withColumn("chunk_", chunk).withColumn("value_", value)
    ahead = F.coalesce(F.sum("all_").over(Window.partitionBy(*keys).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*keys, "chunk_").agg(F.sum("value_").alias("all_")).withColumn("ahead_", ahead)
    sums = sums.select(*[F.col(k).alias(k + "_") for k in keys], F.col("chunk_").alias("c_"), "ahead_")
    inside = F.coalesce(F.sum("value_").over(Window.partitionBy(*keys, "chunk_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(k + "_")) for k in keys] + [F.col("chunk_") == F.col("c_")]
    joined = rows.withColumn("in_", inside).join(sums, same).withColumn(name, F.col("ahead_") + F.col("in_"))
    return joined.drop("chunk_", "value_", "in_", "ahead_", "c_", *[k + "_" for k in keys])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 100_000, shards: int = 16, seed: int = 11) -> DataFrame:
    """The mix of `docs(key, source, size)`, one row for each time that a text is taken: key, source, size, source_size, target, repeat, shard, place.

    key must be distinct for each row and non-null, size is the number of words. A source's taken words differ from its
    target by at most half of one text. place: from 0, where the text stands in its shard, whose draws are shuffled. A
    column `order` (long), if there is one, is hashed for the permutations instead of key; it need not be distinct.
    Texts of size 0 are taken with the blocks they are in. The seed fixes the result: reruns agree, but for which of the
    rows with equal `order` is which. Where all sizes are 0, and with an empty table, the mix is empty.
    """
    order = F.col("order") if "order" in docs.columns else F.col("key")
    rows = docs.select("key", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), order.alias("order"))
    src = lambda name: F.col("source").eqNullSafe(F.col(name))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most).filter("source_size > 0")
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    plan = plan.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).select(F.col("source").alias("s"), "source_size", "target", "n_blocks", "passes", "rest"))

    # 53 bits of a seeded hash permute the texts; equal ranges of it are the blocks
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "order"), 11)
    placed = rows.join(plan, src("s")).withColumn("spot", spot).withColumn("block", F.floor(F.col("spot") / F.lit(float(1 << 53)) * F.col("n_blocks")).cast("long"))
    blocks = placed.groupBy("s", "block", "rest", "passes").agg(F.sum("size").alias("words"))
    blocks = cut(_numbered(blocks, ["s"], F.floor(F.col("block") / CHUNK), ["block"], F.col("words"), "begin"))
    blocks = blocks.withColumn("whole", F.col("begin") + F.col("words") <= F.col("rest")).withColumn("part", (F.col("begin") < F.col("rest")) & ~F.col("whole"))

    # draws of a source: `passes` of every block, and one more of the first ones; each draw has a number in a permuted order
    draws = blocks.withColumn("again", F.col("whole") | F.col("part")).withColumn("repeat", F.explode(F.expr("filter(sequence(cast(0 as bigint), passes), x -> x < passes OR again)")))
    turn = F.xxhash64(F.lit(seed), "block", "repeat")
    draws = cut(_numbered(draws, ["s"], F.shiftright(turn, 64 - CHUNK_BITS), [turn, "repeat", "block"], F.lit(1), "number"))

    def deal(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=lambda i: (t["s"][i].as_py() is None, t["s"][i].as_py() or ""))
        quotas = t["n"].to_numpy()[order].astype(np.int64)
        got = split(quotas, shards, np.random.default_rng(seed)).T
        return pa.table({"s": t["s"].take(order), "ends": pa.array(np.cumsum(got, axis=1).tolist(), pa.list_(pa.int64()))})

    # one row for each source goes to one task here, never the texts or blocks
    ends = draws.groupBy("s").agg(F.count("*").alias("n")).groupBy().applyInArrow(deal, "s string, ends array<long>").select(F.col("s").alias("s2"), "ends")
    dealt = draws.join(ends, F.col("s").eqNullSafe(F.col("s2"))).withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("number"))))
    dealt = cut(dealt.select(F.col("s").alias("s3"), F.col("block").alias("b3"), "begin", "part", "repeat", "shard"))

    taken = placed.join(dealt, src("s3") & (F.col("block") == F.col("b3")))
    last = F.col("part") & (F.col("repeat") == F.col("passes"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("s3", "block").orderBy("spot", "size", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = taken.filter(last).withColumn("before", F.col("begin") + before).filter(F.col("before") + F.col("size") / 2 <= F.col("rest")).drop("before")
    every = cut(taken.filter(~last).unionByName(edge).select("key", "source", "size", "source_size", "target", "repeat", "shard", "order"))
    at = F.xxhash64(F.lit(seed), "shard", "repeat", "order")
    shuffled = _numbered(every, ["shard"], F.shiftright(at, 64 - CHUNK_BITS), [at, "repeat", "size", "key"], F.lit(1), "place")
    return shuffled.select("key", "source", "size", "source_size", "target", "repeat", "shard", "place")
