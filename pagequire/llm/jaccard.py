"""Similarity join of texts on their word shingles, by exact Jaccard similarity.

1. Each text becomes the set of hashes of its k-word shingles, named by a digest, so equal texts are one set from here on.
2. Two sets that are similar enough share a shingle among each one's first few, in any order that all sets agree on.
   The order puts shingles that are frequent within a batch of texts last and goes by hash otherwise. Only these
   prefixes are shuffled; a group is the sets that hold one shingle in their prefix.
3. Groups are compared in tiles. Members are dealt by size band and hash into blocks of a bounded size, and blocks of
   one band or of neighbouring ones meet. Each set carries a hashed bitmap, as wide as its band; bits of one that the
   other lacks bound the overlap from above. Sets with a partner that the bound leaves possible come back with their
   sorted arrays, which are intersected exactly. A tile hands on its members, or a forest of links, never pairs.
4. A first round takes two groups of each set only, a block at a time, with a few members of each group in all of its
   blocks, so that most copies link up in work that grows with the sets. The second takes every group that still holds
   sets of more than one component, and compares the bitmaps of all pairs of different components. What these leave
   possible falls into clusters; each set is in one at most, so its array travels for that one and not for each group.
   All pairs of different components in a cluster meet in tiles once more, with arrays. If one component makes up most
   of a large group or cluster, its members meet the others only.
5. Links become components.

Bitmaps and arrays are drawn anew from the texts when tiles need them, so no set is stored before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .store import bit_set, cut, in_bit_set, modest_batches
from .words import SPACED, hashed, shingled

_U = np.uint64
#: Most texts are the first of their set, so that ids of a smaller bit set would soon tell none apart; 8 MB.
FIRST_BITS = 26
#: Into so many parts a frequent shingle's group is split.
SALTS = 64
#: So many names of sets are kept in a task before they are forgotten.
SEEN = 500_000
#: Texts that are hashed, and pairs that are compared, at a time.
TEXTS, PAIRS = 256, 1 << 17
KEY = ("g", "kind", "low", "i", "j")


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for lo in range(0, len(texts), TEXTS):
        words, _, counts = hashed(texts.slice(lo, TEXTS).to_pylist(), SPACED)
        ends = np.cumsum(counts)
        for end, n in zip(ends, counts, strict=True):
            yield np.unique(shingled(words[end - n : end], k))


def _names(values: np.ndarray, bits: int) -> tuple[int, int]:
    """The set's short name, and a second one for sets that share the first."""
    digest = xxhash.xxh3_128_intdigest(values.tobytes())
    return int(np.int64(np.uint64(digest & ((1 << bits) - 1)))), int(np.int64(np.uint64(digest >> 64)))


def described(docs: DataFrame, k: int, often: int = 3, batch: int = 1_000_000, bits: int = 64) -> DataFrame:
    """For each row (id, n, set, other): the size and names of its shingle set; and, with null id, (set, n): a shingle that n texts of one batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: set[tuple[int, int]] = set()

        def frequent() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            slot = (every >> _U(42)).astype(np.int32)
            every = every[np.bincount(slot, minlength=1)[slot] >= often] if every.size else every
            values, n = np.unique(every, return_counts=True)
            held.clear()
            names.clear()
            values, n = values[n >= often], n[n >= often]
            none = pa.nulls(values.size, pa.int64())
            return pa.record_batch({"id": none, "n": pa.array(n, pa.int64()), "set": pa.array(values.view(np.int64)), "other": none})

        size = 0
        for b in batches:
            ids, ns, sets = b.column(0), [], []
            for values in _sets(b.column(1), k):
                ns.append(values.size)
                sets.append(_names(values, bits))
                if sets[-1] not in names:
                    names.add(sets[-1])
                    held.append(values)
                    size += values.size
                if size > batch:
                    yield frequent()
                    size = 0
            yield pa.record_batch({"id": ids.cast(pa.int64()), "n": pa.array(ns, pa.int64()), "set": pa.array([s for s, _ in sets], pa.int64()), "other": pa.array([o for _, o in sets], pa.int64())})
        yield frequent()

    return docs.filter("id IS NOT NULL").select("id", F.col("text").cast("binary")).mapInArrow(run, "id long, n long, set long, other long")


class _Scan:
    """Passes over the texts that make something of sets, each by the name that `join` settled on."""

    def __init__(self, docs: DataFrame, k: int, bits: int, shared: frozenset[int]):
        self.texts = docs.filter("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long"), F.col("text").cast("binary"))
        self.k, self.bits, self.shared = k, bits, shared

    def over(self, ids: DataFrame, log_bits: int, make: Callable[[list[int], list[np.ndarray]], pa.RecordBatch], schema: str, once: bool) -> DataFrame:
        """`make` of the names and arrays of texts whose ids may be among `ids(first)`; with `once`, a task gives each set once."""
        k, bits, shared, most = self.k, self.bits, self.shared, SEEN
        wanted = ids.sparkSession.sparkContext.broadcast(bit_set(ids, F.col("first"), log_bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                b = b.filter(pa.array(in_bit_set(wanted.value, b.column(0).to_numpy()), pa.bool_()))
                for lo in range(0, b.num_rows, TEXTS):
                    names, arrays = [], []
                    if len(seen) > most:
                        seen.clear()
                    for values in _sets(b.column(1).slice(lo, TEXTS), k):
                        if values.size:
                            name, other = _names(values, bits)
                            name = other if name in shared else name
                            if name not in seen:
                                names.append(name)
                                arrays.append(values)
                                if once:
                                    seen.add(name)
                    if names:
                        yield make(names, arrays)

        return self.texts.mapInArrow(run, schema)


def _prefixes(scan: _Scan, first: DataFrame, num: int, den: int, late: np.ndarray) -> DataFrame:
    """(t, s, n, hot): the first shingles of each set; `late`: those that come last in the order, in that order, told by hot.

    Texts are read by the ids in `first(s, first)`, told by a bit set, and a task hands on each set once: of copies that
    are many, few reach the shuffle. While ids are dense and fewer than 2**FIRST_BITS, none do.
    """
    sc = first.sparkSession.sparkContext
    shared, rank = sc.broadcast(np.sort(late)), sc.broadcast(np.argsort(late, kind="stable").astype(np.int32))

    def make(names: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
        known, order = shared.value, rank.value
        firsts, last = [], []
        for values in arrays:
            need = values.size - -(-num * values.size // den) + 1
            early = values.size
            if known.size:
                at = np.minimum(np.searchsorted(known, values), known.size - 1)
                hot = known[at] == values
                behind = values[hot][np.argsort(order[at[hot]], kind="stable")]
                values = np.concatenate([values[~hot], behind])
                early -= behind.size
            firsts.append(values[:need])
            last.append(np.arange(need) >= early)
        count = [f.size for f in firsts]
        sizes = np.array([a.size for a in arrays], np.int32)
        return pa.record_batch({"t": pa.array(np.concatenate(firsts).view(np.int64)), "s": pa.array(np.repeat(np.array(names, np.int64), count)), "n": pa.array(np.repeat(sizes, count)), "hot": pa.array(np.concatenate(last))})

    return scan.over(first, FIRST_BITS, make, "t long, s long, n int, hot boolean", True)


def _groups(prefixes: DataFrame) -> DataFrame:
    """(g, s, n, w): the distinct groups of two sets or more, each named by its members, in a way that no group is too large for; w: how many shingles have this group.

    A group of a late shingle is split by set, so that no task gets all of it; what names it is put together from
    partial aggregates, of which there are as many as late shingles at most, so they are broadcast.
    """
    members = F.bit_xor(F.xxhash64("s")), F.bit_xor(F.xxhash64(F.lit(7), "s")), F.count("*")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(9), "s"), F.lit(SALTS))).otherwise(-1).cast("int")
    by = Window.partitionBy("t", "salt")
    # one shuffle and one sort serve all of this
    dealt = prefixes.withColumn("salt", salt).repartition("t", "salt").withColumn("before", F.lag("s").over(by.orderBy("s"))).filter("before IS NULL OR before <> s")
    shared = dealt.withColumn("c", F.count("*").over(by)).filter("c > 1 OR hot")
    named = cut(shared.select(F.when(F.col("hot"), F.col("t")).alias("t"), "s", "n", F.when(~F.col("hot"), F.xxhash64(*[m.over(by) for m in members])).alias("g")))
    late = named.filter("t IS NOT NULL").groupBy("t").agg(F.xxhash64(*members).alias("late"), F.count("*").alias("c")).filter("c > 1").drop("c")
    full = named.join(F.broadcast(late), "t", "left").withColumn("g", F.coalesce("g", "late")).filter("g IS NOT NULL")
    return full.groupBy("g", "s").agg(F.first("n").alias("n"), F.count("*").alias("w"))


def _drawn(scan: _Scan, first: DataFrame, sets: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(s, x): what `make` gives of the sorted shingles of each of `sets(s)`, and of a few others.

    Texts are read anew, but only those are hashed whose ids `first(s, first)` names for these sets, told by a bit set
    of 32 bits or more for each of up to 4 million; with far more than 2**27 of them, other sets are drawn in vain too.
    """
    ids = cut(first.join(sets, "s", "left_semi").select("first"))
    rows = lambda names, arrays: pa.record_batch({"s": pa.array(names, pa.int64()), "x": pa.array([make(a) for a in arrays], pa.binary())})
    made = scan.over(ids, min(27, max(22, ids.count().bit_length() + 5)), rows, "s long, x binary", True)
    return made.groupBy("s").agg(F.first("x").alias("x"))


def _bitmap(values: np.ndarray, width: int) -> np.ndarray:
    """Words of a bitmap with `width` to twice as many bits for each element, 512 at least, which is little beside a row's other columns; fewer in sets of over 2**20 / width."""
    log_bits = min(20, max(9, (int(values.size) * width - 1).bit_length()))
    bits = np.zeros(1 << log_bits, np.uint8)
    bits[(values >> _U(7)) & _U((1 << log_bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _band(num: int, den: int) -> Column:
    """Bands grow by den / num, so similar sets are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")


def _most(num: int, den: int, tile: int) -> Column:
    """How many sets of a band make a block: their arrays take some 32 MB at most."""
    return F.least(F.lit(float(tile)), F.greatest(F.lit(64.0), (1 << 22) / F.pow(F.lit(den / num), F.col("band") + 1)))


def _beside(name: str, step: int) -> Column:
    """A column of the group's band that is `step` away, 0 if there is none."""
    by = Window.partitionBy("g").orderBy("band")
    there = F.lead("band", step).over(by) == F.col("band") + step
    return F.when(there, F.lead(name, step).over(by)).otherwise(0)


def _first_tiles(groups: DataFrame, num: int, den: int, tile: int, pivots: int) -> DataFrame:
    """(KEY, side, s, n, root): two groups of each set, one block of a band in a tile, with pivots of its band and the next.

    The groups are the one that most of a set's shingles have and the one whose hash is lowest; copies mostly agree.
    """
    h = F.xxhash64("g")
    two = groups.groupBy("s").agg(F.first("n").alias("n"), F.max(F.struct("w", h, "g")).alias("a"), F.min(F.struct(h, "g")).alias("b"))
    rows = cut(two.select("s", "n", F.explode(F.array_distinct(F.array("a.g", "b.g"))).alias("g")).withColumn("band", _band(num, den)))
    counts = cut(rows.groupBy("g", "band").agg(F.count("*").alias("c")).withColumn("k", F.ceil(F.col("c") / _most(num, den, tile)).cast("int")))
    own = rows.join(counts, ["g", "band"]).select("g", "s", "n", F.col("band").alias("low"), F.pmod(F.xxhash64("s"), "k").cast("int").alias("i"))
    slot = F.pmod(F.xxhash64(F.lit(3), "s"), F.lit(pivots))
    best = rows.groupBy("g", "band", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit(5), "s"), "s", "n")).alias("p")).select("g", "band", "p.s", "p.n")
    blocks = counts.filter("k > 1").select("g", "band", F.col("band").alias("low"), "k").unionByName(counts.select("g", (F.col("band") + 1).alias("band"), F.col("band").alias("low"), "k"))
    placed = best.join(blocks, ["g", "band"]).select("g", "s", "n", "low", F.explode(F.expr("sequence(0, k - 1)")).alias("i"))
    every = own.unionByName(placed)
    return every.select("g", F.lit(0).alias("kind"), "low", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "s", "n", F.col("s").alias("root"))


def _all_tiles(members: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """(KEY, side, s, n, root): tiles in which all pairs of different roots of `members(g, s, n, root)` meet.

    Groups with one root are left out. kind: 0 two blocks of one band, 1 of neighbouring ones; if a root has more than
    `tile` members of a group, these are in blocks of their own, which meet the others' in their band (2), from the
    band below (3) and from that above (4), but not each other.
    """
    sizes = members.groupBy("g", "root").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("g").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("m")).filter("roots > 1")
    open_ = open_.select("g", F.when(F.col("m.c") > tile, F.col("m.root")).alias("big"))
    rows = members.join(open_, "g").select("g", "s", "n", "root", F.col("root").eqNullSafe(F.col("big")).alias("main"), _band(num, den).alias("band"))
    rows = cut(rows)  # in parts: as one plan, this had hundreds of nodes, of which the driver keeps descriptions and threads
    blocks = lambda c: F.ceil(c / _most(num, den, tile)).cast("int")
    counts = rows.groupBy("g", "band").agg(F.count_if(~F.col("main")).alias("co"), F.count_if("main").alias("cb"))
    counts = counts.select("g", "band", "co", blocks(F.col("co")).alias("ko"), blocks(F.col("cb")).alias("kb"))
    near = cut(counts.select("*", *[_beside(c, step).alias(f"{c}_{name}") for c in ("ko", "kb") for name, step in (("up", 1), ("dn", -1))]))
    dealt = rows.join(near, ["g", "band"]).withColumn("h", F.pmod(F.xxhash64("s"), F.when(F.col("main"), F.col("kb")).otherwise(F.col("ko"))).cast("int"))

    def meets(with_: str, kind: int, low: str, i: str, j: str, side: str) -> str:
        place = f"named_struct('kind', {kind}, 'low', {low}, 'i', {i}, 'j', {j}, 'side', {side})"
        return f"if({with_} > 0, transform(sequence(0, {with_} - 1), x -> {place}), array())"

    own = meets("if(co > 1, ko, 0)", 0, "band", "least(h, x)", "greatest(h, x)", "cast(h > x as int)")
    other = [own, meets("ko_up", 1, "band", "h", "x", "0"), meets("ko_dn", 1, "band - 1", "x", "h", "1"), meets("kb", 2, "band", "h", "x", "0"), meets("kb_up", 3, "band", "h", "x", "0"), meets("kb_dn", 4, "band", "h", "x", "0")]
    main = [meets("ko", 2, "band", "x", "h", "1"), meets("ko_dn", 3, "band - 1", "x", "h", "1"), meets("ko_up", 4, "band + 1", "x", "h", "1")]
    places = F.when(F.col("main"), F.expr(f"concat({', '.join(main)})")).otherwise(F.expr(f"concat({', '.join(other)})"))
    return dealt.select("g", "s", "n", "root", F.explode(places).alias("p")).select("g", "p.*", "s", "n", "root").select(*KEY, "side", "s", "n", "root")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by KEY, so that no tile is in two tables."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        keys = [t.column(c).to_numpy() for c in KEY]
        last = int(np.flatnonzero(np.logical_or.reduce([np.append(True, k[1:] != k[:-1]) for k in keys]))[-1])
        if last:
            yield t.slice(0, last)
        held = t.slice(last)
    if held is not None:
        yield held


def _meeting(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in their tiles, in chunks: each pair once, blocks with themselves and with others."""
    side, i, j, *keys = (t.column(c).to_numpy() for c in ("side", "i", "j", "g", "kind", "low"))
    n = side.size
    new = np.logical_or.reduce([np.append(True, k[1:] != k[:-1]) for k in (*keys, i, j)])
    tile = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[tile]
    twos = np.bincount(tile, weights=side).astype(np.int64)[tile]
    alone = (keys[1] == 0) & (i == j)
    at = np.arange(n)
    begin = np.where(alone, at + 1, np.where(side == 0, ends - twos, ends))
    count = np.cumsum(ends - begin)
    lo = 0
    while lo < n:
        before = count[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(count, before + PAIRS, "right")))
        each = (ends - begin)[lo:hi]
        x = np.repeat(at[lo:hi], each)
        if x.size:
            yield x, np.arange(x.size) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[lo:hi], each)
        lo = hi


class _Maps:
    """Bitmaps of rows, of several widths."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, size: np.ndarray):
        self.words, self.starts, self.size = words, starts, size

    def _folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((rows.size, size), np.uint64)
        for own in np.unique(self.size[rows]):
            at = np.flatnonzero(self.size[rows] == own)
            full = self.words[self.starts[rows[at]][:, None] + np.arange(own)]
            out[at] = np.bitwise_or.reduce(full.reshape(at.size, -1, size), axis=1)
        return out

    def possible(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether the overlap may be large enough: a bit that the other lacks stands for one element at least that it lacks."""
        ok = np.zeros(x.size, bool)
        width = np.minimum(self.size[x], self.size[y])
        for size in np.unique(width):
            of = np.flatnonzero(width == size)
            step = max(1, (1 << 18) // int(size))
            for lo in range(0, of.size, step):
                p = of[lo : lo + step]
                a, ia = np.unique(x[p], return_inverse=True)
                b, ib = np.unique(y[p], return_inverse=True)
                fa, fb = self._folded(a, int(size))[ia], self._folded(b, int(size))[ib]
                both = np.bitwise_count(fa & fb).sum(1, dtype=np.int64)
                alone_a = np.bitwise_count(fa).sum(1, dtype=np.int64) - both
                alone_b = np.bitwise_count(fb).sum(1, dtype=np.int64) - both
                most = np.minimum(n[x[p]] - alone_a, n[y[p]] - alone_b)
                ok[p] = (num + den) * most >= num * (n[x[p]] + n[y[p]])
        return ok


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit words of a binary column, and where each row's begin and how many they are."""
    chunks = t.column(name).chunks
    arr = chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64) // 8
    return np.frombuffer(data, np.uint64, int(off[-1])), off[:-1], np.diff(off)


def _possible(t: pa.Table, num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which rows have a partner in their tile that the bitmaps leave possible, a forest of such pairs).

    Rows that the forest already joins are not compared again.
    """
    n, root = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "root"))
    maps = _Maps(*_flat(t, "x"))
    up = list(range(n.size))
    label = np.arange(n.size)
    forest: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in _meeting(t):
        ok = (root[x] != root[y]) & (label[x] != label[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        ok = maps.possible(x, y, n, num, den)
        before = len(forest)
        for a, b in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            one, two = top(a), top(b)
            if one != two:
                up[two] = one
                forest.append((a, b))
        if len(forest) > before:
            label = np.array([top(r) for r in range(n.size)])
    alive = np.zeros(n.size, bool)
    alive[np.array(forest, np.int64).reshape(-1)] = True
    return alive, forest


def _linked(t: pa.Table, num: int, den: int, width: int) -> list[tuple[int, int]]:
    """Pairs of rows that link, enough of them to join all components that links in the tiles join."""
    n, s = t.column("n").to_numpy().astype(np.int64), t.column("s").to_numpy()
    _, label = np.unique(t.column("root").to_numpy(), return_inverse=True)
    values, starts, size = _flat(t, "x")
    _, where, own = np.unique(s, return_index=True, return_inverse=True)
    drawn = [_bitmap(values[starts[r] : starts[r] + size[r]], width) for r in where]
    length = np.array([d.size for d in drawn])
    maps = _Maps(np.concatenate(drawn), (np.cumsum(length) - length)[own], length[own])
    out: list[tuple[int, int]] = []
    for x, y in _meeting(t):
        ok = (label[x] != label[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        ok = maps.possible(x, y, n, num, den)
        x, y = x[ok], y[ok]
        for lo, hi in zip(*((edge := np.flatnonzero(np.append(True, x[1:] != x[:-1]))), np.append(edge[1:], x.size)), strict=True) if x.size else ():
            a, others = x[lo], y[lo:hi]
            one = values[starts[a] : starts[a] + size[a]]
            while (others := others[label[others] != label[a]]).size:
                # all partners' sorted arrays at once, a bounded number of elements at a time
                part = others[: max(1, int(np.searchsorted(np.cumsum(size[others]), 1 << 20, "right")))]
                others = others[part.size :]
                many = np.concatenate([values[starts[b] : starts[b] + size[b]] for b in part])
                at = np.searchsorted(one, many)
                at[at == one.size] = 0
                common = np.add.reduceat((one[at] == many).astype(np.int64), np.cumsum(size[part]) - size[part])
                for b in part[den * common >= num * (n[a] + n[part] - common)]:
                    if label[b] != label[a]:
                        out.append((a, b))
                        label[label == label[b]] = label[a]
    return out


def _dealt(tiles: DataFrame, content: DataFrame) -> DataFrame:
    """Tile rows with their sets' content, a tile's rows together and in the order of sides."""
    full = tiles.join(content, "s").select(*KEY, "side", "s", "n", "root", "x")
    return full.repartition(*KEY).sortWithinPartitions(*KEY, "side", "s")


class _Joined:
    """Edges of one task after another, without those between sets that it has joined already; it forgets when it has seen many."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def edges(self, s: np.ndarray, forest: list[tuple[int, int]]) -> pa.RecordBatch:
        if len(self.up) > SEEN:
            self.up.clear()
        new = []
        for a, b in s[np.array(forest, np.int64).reshape(-1, 2)].tolist():
            one, two = self._top(a), self._top(b)
            if one != two:
                self.up[two] = one
                new.append((a, b))
        a, b = np.array(new, np.int64).reshape(-1, 2).T
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


class _Tiled:
    """Links between sets of different roots that meet in tiles."""

    def __init__(self, sketches: DataFrame, arrays: Callable[[DataFrame], DataFrame], num: int, den: int, tile: int):
        self.sketches, self.arrays, self.num, self.den, self.tile = sketches, arrays, num, den, tile

    def exact(self, tiles: DataFrame) -> DataFrame:
        """(a, b): links by sorted arrays, a forest of them for each tile; checkpointed."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joined = _Joined()
            for t in _whole(batches):
                yield joined.edges(t.column("s").to_numpy(), _linked(t, num, den, 8))

        return cut(_dealt(tiles, self.arrays(tiles.select("s"))).mapInArrow(run, "a long, b long"))

    def first(self, groups: DataFrame, pivots: int) -> DataFrame:
        num, den = self.num, self.den

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole(batches):
                yield from t.filter(pa.array(_possible(t, num, den)[0])).drop_columns(["x"]).combine_chunks().to_batches()

        tiles = _dealt(_first_tiles(groups, num, den, self.tile, pivots), self.sketches)
        return self.exact(cut(tiles.mapInArrow(bound, "g long, kind int, low int, i int, j int, side int, s long, n int, root long")))

    def rest(self, members: DataFrame) -> DataFrame:
        num, den = self.num, self.den

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joined = _Joined()
            for t in _whole(batches):
                yield joined.edges(t.column("s").to_numpy(), _possible(t, num, den)[1])

        near = cut(_dealt(_all_tiles(members, num, den, self.tile), self.sketches).mapInArrow(bound, "a long, b long"))
        if near.isEmpty():
            return near
        clusters = components(near).select(F.col("id").alias("s"), F.col("root").alias("g"))
        each = members.groupBy("s").agg(F.first("n").alias("n"), F.first("root").alias("root"))
        inside = cut(clusters.join(each, "s").select("g", "s", "n", "root"))
        return self.exact(cut(_all_tiles(inside, num, den, self.tile)))


def join(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4, pivots: int = 8, late: int = 200_000, tile: int = 1024, bits: int = 64) -> DataFrame:
    """(id, n_shingles, component) for each row of `docs(id long, text)`.

    Rows without an id link like others, by numbers above all ids (which leave room for these below 2**63); where no id is
    reached, component is null too. Texts link if the Jaccard similarity of their sets of k-word shingles is at least num / den; component is the
    smallest id that links reach. Texts without words, and null ones, have the empty set and link to nothing. Repeated
    ids give a row each; an empty table gives an empty one. late: shingles that are put last in the order; they only
    change how much work there is, not the result. pivots: of each group's band in the first round, which only spares
    work as well. tile: sets that one tile compares with each other or with as many, fewer if they are large.
    Shingles are told apart by 64-bit hashes, sets by digests of 128 bits; bits: of the shorter name that sets go by,
    unless two share it.
    """
    docs = docs.select("id", "text")
    lost = docs.filter("id IS NULL")
    if not lost.isEmpty():
        top = docs.agg(F.max("id")).first()[0] or 0
        lost = cut(lost.withColumn("id", F.lit(top + 1).cast("long") + F.monotonically_increasing_id()))
        got = join(docs.filter("id IS NOT NULL").unionByName(lost), k, num, den, pivots, late, tile, bits)
        return got.select(F.when(F.col("id") <= top, F.col("id")).alias("id"), "n_shingles", F.when(F.col("component") <= top, F.col("component")).alias("component"))
    modest_batches(docs.sparkSession)
    seen = cut(described(docs, k, bits=bits))
    hot = seen.filter("id IS NULL").groupBy("set").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "set").limit(late).toPandas()
    last = hot.sort_values(["n", "set"])["set"].to_numpy(np.int64).view(np.uint64)
    members = seen.filter("id IS NOT NULL").select("id", F.col("n").alias("n_shingles"), F.col("set").alias("s"), "other")
    # names of 64 bits that different sets share: of N sets, N * N / 2**65 are to be expected
    twice = members.groupBy("s").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.min("id").alias("first"))
    first = cut(twice.withColumn("shared", F.col("lo") < F.col("hi")).select("s", "first", "shared"))
    shared = [r["s"] for r in first.filter("shared").select("s").collect()]
    if shared:
        members = members.withColumn("s", F.when(F.col("s").isin(shared), F.col("other")).otherwise(F.col("s")))
        first = cut(members.groupBy("s").agg(F.min("id").alias("first")))
    members = members.drop("other")
    some = members.filter("n_shingles > 0")
    scan = _Scan(docs, k, bits, frozenset(shared))

    groups = cut(_groups(_prefixes(scan, first, num, den, last)))
    arrays = lambda sets: _drawn(scan, first, sets, lambda v: v.tobytes())
    roots = None
    if not groups.isEmpty():
        sketches = cut(_drawn(scan, first, groups.select("s"), lambda v: _bitmap(v, 2).tobytes()))
        tiled = _Tiled(sketches, arrays, num, den, tile)
        links = tiled.first(groups, pivots)
        roots = cut(components(links)).withColumnRenamed("id", "s")
        rooted = cut(groups.select("g", "s", "n").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
        more = tiled.rest(rooted)
        if not more.isEmpty():
            roots = cut(components(links.unionByName(more))).withColumnRenamed("id", "s")
    if roots is None:
        roots = some.limit(0).select("s", F.col("s").alias("root"))
    rooted = cut(first.select("s", "first").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("s", "component")
    full = some.join(named, "s").select("id", "n_shingles", "component")
    return full.unionByName(members.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component")))
