"""The recursive X-Y cut, one level of many pages at a time.

A region is a rectangle of a page with both ends included; its ink is slabs (y0, y1, x0, x1), runs that neighbouring
lines share. At each level every live region is projected, trimmed to its ink and split: at its widest empty band, else
at a thin drawn line, else along a slanted band; regions without any are leaves. Seven levels at most, whatever the corpus.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .raster import ENDS, fields, lists_of, packed_slabs, parts, profile, slabs

KEYS = ("page_id", "path")
#: Slopes of slanted bands, in the order in which they are tried.
SLOPES = (0.035, -0.035, 0.061, -0.061, 0.087, -0.087, 0.115, -0.115, 0.141, -0.141)
#: Slabs times places that a task tries slopes on at once; a region with more is a part of its own.
PART = 1 << 21


def trim(ink: DataFrame, *keys: str) -> DataFrame:
    """(keys, x0, y0, x1, y1, ink): the bounding box of a region's runs or slabs; regions without ink vanish."""
    ink = slabs(ink)
    area = F.sum(F.expr("(x1 - x0 + 1) * (y1 - y0 + 1)")).cast("long")
    return ink.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), area.alias("ink"))


def gutters(ink: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, start, len): interior bands of near-empty lines of at least min_len.

    spans(keys, row_span, col_span, min_len): the extent that a row or a column is measured against. A line is empty if
    count * 1000 <= span * 5; ink is a profile. Bands are what lies between a line with ink and the next one, so they never touch the ends.
    """
    span = F.when(F.col("axis") == "row", F.col("row_span")).otherwise(F.col("col_span"))
    inked = ink.join(spans, list(keys)).filter(F.col("count") * 1000 > span * 5)
    w = Window.partitionBy(*keys, "axis").orderBy("pos")
    bands = inked.withColumn("start", F.col("last") + 1).withColumn("len", F.lead("pos").over(w) - F.col("last") - 1)
    return bands.filter("len >= min_len").select(*keys, "axis", "start", "len")


def widest(bands: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, start, len): the longest band of each region and axis; the first of equals."""
    best = bands.groupBy(*keys, "axis").agg(F.max(F.struct("len", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(*keys, "axis", (-F.col("b.s")).alias("start"), F.col("b.len").alias("len"))


def border_lines(dark: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, start, len): the narrowest drawn line of each region and axis; the first of equals.

    dark: a profile of border cells within boxes(keys, x0, y0, x1, y1, max_width, min_side). A line is drawn where 97 % of
    its span are border cells; a run of such lines is a stroke if it is no wider than max_width and leaves min_side
    lines on each side.
    """
    row = F.col("axis") == "row"
    at = dark.join(boxes, list(keys)).withColumn("lo", F.when(row, F.col("y0")).otherwise(F.col("x0"))).withColumn("hi", F.when(row, F.col("y1")).otherwise(F.col("x1")))
    span = F.when(row, F.expr("x1 - x0 + 1")).otherwise(F.expr("y1 - y0 + 1"))
    order = Window.partitionBy(*keys, "axis").orderBy("pos")
    dense = at.filter(F.col("count") * 100 >= span * 97).withColumn("new", F.when(F.lag("last").over(order) == F.col("pos") - 1, 0).otherwise(1))
    runs = dense.withColumn("i", F.sum("new").over(order)).groupBy(*keys, "axis", "i", "lo", "hi", "max_width", "min_side").agg(F.min("pos").alias("start"), F.max("last").alias("stop"))
    fits = runs.withColumn("len", F.expr("stop - start + 1")).filter("start > lo AND stop < hi AND len <= max_width AND start - lo >= min_side AND hi - stop >= min_side")
    best = fits.groupBy(*keys, "axis").agg(F.min(F.struct("len", "start")).alias("b"))
    return best.select(*keys, "axis", "b.start", "b.len")


def _lines(first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(slab, place) of every step-th line, counted from lo, that slabs from first to last hold within lo and hi."""
    begin = lo - (lo - np.maximum(first, lo)) // step * step
    n = np.maximum(0, (np.minimum(last, hi) - begin) // step + 1)
    of = np.repeat(np.arange(n.size), n)
    return of, begin[of] + (np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)) * step


def _slanted(slope: float, step: int, lines: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, start, len): the longest band that fits of each region that has any, first of equals, for one axis.

    lines(region, at, b0, b1): stretches that move with `at`. r(low, high, mid, extent, min_len): regions, whose places lie end to end in one array.
    """
    room = r["high"] - r["low"] + 2
    offset = np.cumsum(room) - room
    of = lines["region"]
    shift = np.floor(slope * (lines["at"] - r["mid"][of]) + 0.5).astype(np.int64)
    lo, hi = np.maximum(lines["b0"] - shift, r["low"][of]), np.minimum(lines["b1"] - shift, r["high"][of])
    met, base = lo <= hi, (offset - r["low"])[of]
    size = int(room.sum())
    count = np.cumsum(np.bincount((base + lo)[met], minlength=size) - np.bincount((base + hi + 1)[met], minlength=size))
    at = np.flatnonzero(count * (1000 * step) > np.repeat(r["extent"] * 5, room))
    owner = np.searchsorted(offset, at, "right") - 1
    n, own = at[1:] - at[:-1] - 1, owner[:-1]
    band = (owner[1:] == own) & (n >= np.maximum(1, r["min_len"][own]))
    own, n = own[band], n[band]
    drift = np.floor(abs(slope) * r["extent"][own] / 2).astype(np.int64) + 1
    lo = at[:-1][band] + 1 - (offset - r["low"])[own] - drift
    length = n + 2 * drift
    fits = (lo > r["low"][own]) & (lo + length - 1 < r["high"][own])
    own, lo, length = own[fits], lo[fits], length[fits]
    best = np.lexsort((lo, -length, own))
    first = best[np.unique(own[best], return_index=True)[1]]
    return own[first], lo[first], length[first]


def _first_slanted(box: dict[str, np.ndarray], slab: dict[str, np.ndarray], slopes: Sequence[float], step: int, hint: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(rank, late, start, len, fits) of each region, rank -1 without a band; late is 1 for rows. Only with a hint are slopes tried after the first that fits."""
    n = box["min_len"].size
    rank, late, start, length, fits = (np.full(n, v, np.int64) for v in (-1, 0, 0, 0, 0))
    sides = []
    for a, b, clipped in (("y", "x", True), ("x", "y", False)):
        r = {"low": box[b + "0"], "high": box[b + "1"], "mid": (box[a + "0"] + box[a + "1"]) // 2, "extent": box[a + "1"] - box[a + "0"] + 1, "min_len": box["min_len"]}
        own = slab["region"]
        of, at = _lines(slab[a + "0"], slab[a + "1"], box[a + "0"][own], box[a + "1"][own], step)
        b0, b1, own = slab[b + "0"][of], slab[b + "1"][of], own[of]
        if clipped:
            b0, b1 = np.maximum(b0, r["low"][own]), np.minimum(b1, r["high"][own])
        sides.append(({"region": own, "at": at, "b0": b0, "b1": b1}, r))
    live = np.arange(n)
    for k, slope in enumerate(slopes):
        before = rank < 0 if hint is None else (rank < 0) | (hint == k)
        for i, (lines, r) in enumerate(sides):
            own, lo, size = _slanted(slope, step, lines, r)
            own = live[own]
            new = before[own] & (fits[own] >> k & 1 == 0)
            fits[own] |= 1 << k
            own = own[new]
            rank[own], late[own], start[own], length[own] = k, i, lo[new], size[new]
        if hint is None:  # regions that are split leave
            stay = rank[live] < 0
            number = np.cumsum(stay) - 1
            sides = [({c: (number[v] if c == "region" else v)[keep] for c, v in lines.items()}, {c: v[stay] for c, v in r.items()}) for lines, r in sides for keep in [stay[lines["region"]]]]
            live = live[stay]
            if not live.size:
                break
    return rank, late, start, length, fits


def sheared(ink: DataFrame, boxes: DataFrame, *keys: str, slopes: Sequence[float] = SLOPES, step: int = 2) -> DataFrame:
    """(keys, axis, start, len): the first slanted band that fits, of slabs within boxes(keys, x0, y0, x1, y1, min_len).

    Every step-th line is moved by slope times its distance from the middle, rounded, and what leaves the region is
    lost. A band counts with the drift that the slope adds on each side, and must end within the region. Slopes go
    in order, columns before rows, wider bands before narrower ones. If boxes have a hint, which is the place of a slope
    or null, that slope goes first, and rank, the place of the slope that split, and fits, bits of all that could, follow.

    A region is a row with its slabs, of which a page's raster bounds the number; a task tries one slope after another on
    those of its regions that are still without a band, many regions at a time.
    """
    hinted = "hint" in boxes.columns
    sides = [*(f"r{c}" for c in ("x0", "y0", "x1", "y1")), "min_len", *(["hint"] if hinted else [])]
    of = boxes.select(*keys, *[F.col(c.removeprefix("r")).cast("long").alias(c) for c in sides])
    slab = F.struct(*[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])
    packed = ink.join(of, list(keys)).groupBy(*keys).agg(*[F.first(c).alias(c) for c in sides], F.collect_list(slab).alias("slabs"))
    kinds = "axis string, start int, len int" + (", rank int, fits int" if hinted else "")
    schema = StructType([*packed.select(*keys).schema.fields, *StructType.fromDDL(kinds).fields])

    def bands(t: pa.Table) -> pa.RecordBatch:
        whole = lambda c: t.column(c).to_numpy()
        lists = t.column("slabs").combine_chunks()
        flat, n = lists.flatten(), lists.value_lengths().to_numpy()
        slabs_of = {c: flat.field(c).to_numpy() for c in ("x0", "y0", "x1", "y1")} | {"region": np.repeat(np.arange(n.size), n)}
        box = {c: whole("r" + c) for c in ("x0", "y0", "x1", "y1")} | {"min_len": whole("min_len")}
        hint = t.column("hint").fill_null(-1).to_numpy() if hinted else None
        rank, late, start, length, fits = _first_slanted(box, slabs_of, slopes, step, hint)
        at = np.flatnonzero(rank >= 0)
        got = {c: t.column(c).take(at).combine_chunks() for c in keys} | {"axis": pa.array(np.where(late[at] == 1, "row", "col").tolist(), pa.string())}
        got |= {c: pa.array(v[at], pa.int32()) for c, v in (("start", start), ("len", length), ("rank", rank), ("fits", fits)) if c in schema.names}
        return pa.record_batch(got)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # parts of about as many places and lines each, so that a task's memory does not depend on what a batch holds
            lists = b.column(b.schema.get_field_index("slabs"))
            ends = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("rx0", "rx1", "ry0", "ry1")]
            cost = np.cumsum((ends[1] - ends[0] + ends[3] - ends[2] + 2) * (1 + lists.value_lengths().to_numpy()))
            for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(cost // PART)) + 1):
                if part.size:
                    yield bands(pa.Table.from_batches([b.slice(int(part[0]), part.size)]))

    return packed.mapInArrow(tried, schema)


def _both(best: DataFrame, *keys: str) -> DataFrame:
    return best.groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{a}_{c}") for a in ("row", "col") for c in ("start", "len")])


#: The slope of the region that split last before this one: paths sort as the recursion visits regions.
_HINT = "try_element_at(filter(slopes, s -> s.path < path), -1).rank"


def decide(ink: DataFrame, limits: DataFrame, *keys: str, borders: DataFrame | None = None, shear: bool = False, memory: DataFrame | None = None) -> DataFrame:
    """Trimmed regions with split (row, col or leaf), start, len and slanted, for limits(page_id, min_len, max_width, min_side).

    Of empty bands the longer wins, of drawn lines the narrower, rows where they are equal. Slanted bands are sought only
    where some line holds 35 % of its span at most. The last two limits are needed with borders only. With
    memory(page_id, slopes), slopes being (path, rank) by path, a region tries the slope of the last path before its own
    first, and rank and fits follow (see `sheared`).
    """
    ink = slabs(ink)
    box = trim(ink, *keys)
    sized = box.join(limits, "page_id").withColumn("row_span", F.expr("x1 - x0 + 1")).withColumn("col_span", F.expr("y1 - y0 + 1"))
    lines = profile(ink, *keys)
    full = box.join(_both(widest(gutters(lines, sized.select(*keys, "row_span", "col_span", "min_len"), *keys), *keys), *keys), list(keys), "left").na.fill(0, ["row_len", "col_len"])
    split = F.when((F.col("row_len") > 0) & (F.col("row_len") >= F.col("col_len")), "row").when(F.col("col_len") > 0, "col").otherwise("leaf")
    slanted = F.lit(False)
    if borders is not None:
        whole = sized.select(*keys, "x0", "y0", "x1", "y1", "max_width", "min_side")
        inside = slabs(borders).join(whole.select(*keys, *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")]), list(keys)).filter("x0 <= rx1 AND x1 >= rx0 AND y0 <= ry1 AND y1 >= ry0")
        inside = inside.select(*keys, *[F.greatest(c, "r" + c).alias(c) for c in ("x0", "y0")], *[F.least(c, "r" + c).alias(c) for c in ("x1", "y1")])
        found = _both(border_lines(profile(inside, *keys), whole, *keys), *keys)
        full = full.join(found.select(*keys, *[F.col(f"{a}_{c}").alias(f"b{a}_{c}") for a in ("row", "col") for c in ("start", "len")]), list(keys), "left")
        drawn = F.when(F.col("brow_len") <= F.coalesce("bcol_len", "brow_len"), "row").when(F.col("bcol_len").isNotNull(), "col")
        full = full.withColumn("split", split).withColumn("drawn", F.when(F.col("split") == "leaf", drawn))
        pick = lambda c: F.when(F.col("drawn") == "row", F.col(f"brow_{c}")).when(F.col("drawn") == "col", F.col(f"bcol_{c}")).when(F.col("split") == "row", F.col(f"row_{c}")).when(F.col("split") == "col", F.col(f"col_{c}"))
        full = full.withColumn("start", pick("start")).withColumn("len", pick("len")).withColumn("split", F.coalesce("drawn", "split"))
    else:
        pick = lambda c: F.when(F.col("split") == "row", F.col(f"row_{c}")).when(F.col("split") == "col", F.col(f"col_{c}"))
        full = full.withColumn("split", split).withColumn("start", pick("start")).withColumn("len", pick("len"))
    full = full.select(*keys, "x0", "y0", "x1", "y1", "ink", "split", "start", "len")
    if shear:
        thin = lines.groupBy(*keys, "axis").agg(F.min("count").alias("least"), F.sum(F.expr("last - pos + 1")).alias("held"))
        row = F.col("axis") == "row"
        across, along = F.when(row, F.col("row_span")).otherwise(F.col("col_span")), F.when(row, F.col("col_span")).otherwise(F.col("row_span"))
        gate = thin.join(sized, list(keys)).filter((F.col("held") < along) | (F.col("least") * 100 <= across * 35)).select(*keys).distinct()
        open_ = sized.join(full.filter("split = 'leaf'").select(*keys), list(keys), "left_semi").join(gate, list(keys), "left_semi")
        hint = []
        if memory is not None:
            open_, hint = open_.join(memory, "page_id", "left").withColumn("hint", F.expr(_HINT)), ["hint"]
        found = sheared(ink, open_.select(*keys, "x0", "y0", "x1", "y1", "min_len", *hint), *keys)
        full = full.join(found.withColumnsRenamed({"axis": "s_axis", "start": "s_start", "len": "s_len"}), list(keys), "left")
        slanted = F.col("s_axis").isNotNull()
        full = full.withColumns({"split": F.coalesce("s_axis", "split"), "start": F.coalesce("s_start", "start"), "len": F.coalesce("s_len", "len"), "slanted": slanted})
    tried = ["rank", "fits"] if shear and memory is not None else []
    return full.withColumn("slanted", slanted).select(*keys, "x0", "y0", "x1", "y1", "ink", "split", "start", "len", "slanted", *tried)


def clip(ink: DataFrame, regions: DataFrame) -> DataFrame:
    """Slabs(page_id, path, y0, y1, x0, x1) cut to the child regions(page_id, parent, path, x0, y0, x1, y1) of their path."""
    child = regions.select("page_id", F.col("parent").alias("p"), F.col("path").alias("child"), *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    met = slabs(ink).withColumnRenamed("path", "p").join(child, ["page_id", "p"]).filter("y0 <= ry1 AND y1 >= ry0 AND x0 <= rx1 AND x1 >= rx0")
    ends = [F.greatest(c, "r" + c).alias(c) for c in ("x0", "y0")] + [F.least(c, "r" + c).alias(c) for c in ("x1", "y1")]
    return met.select("page_id", F.col("child").alias("path"), *ends)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, within spark.checkpoint.dir; only a local session may go without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(known or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def children(regions: DataFrame) -> DataFrame:
    """(page_id, parent, path, x0, y0, x1, y1): both parts of each split region; a slanted band belongs to both, any other to none."""
    row = F.col("split") == "row"
    before = F.col("start") - F.when(F.col("slanted"), 1 - F.col("len")).otherwise(1)
    after = F.col("start") + F.when(F.col("slanted"), 0).otherwise(F.col("len"))
    path = lambda k: (F.col("path").alias("parent"), F.concat("path", F.lit(k)).alias("path"))
    first = regions.select("page_id", *path("0"), "x0", "y0", F.when(row, F.col("x1")).otherwise(before).alias("x1"), F.when(row, before).otherwise(F.col("y1")).alias("y1"))
    second = regions.select("page_id", *path("1"), F.when(row, F.col("x0")).otherwise(after).alias("x0"), F.when(row, after).otherwise(F.col("y0")).alias("y0"), "x1", "y1")
    return first.unionByName(second)


def _levels(live: DataFrame, dark: DataFrame | None, limits: DataFrame, depth: int, shear_depth: int, memory: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Leaves, and (page_id, path, rank, fits) of the slanted splits if there is a memory; lineage is cut by level."""
    leaves = tried = None
    for level in range(depth + 1):
        if level < depth:
            regions = decide(live, limits, *KEYS, borders=dark, shear=level <= shear_depth, memory=memory)
        else:
            regions = trim(live, *KEYS).withColumns({"split": F.lit("leaf"), "start": F.lit(0), "len": F.lit(0), "slanted": F.lit(False)})
        regions = kept(regions)
        done = regions.filter("split = 'leaf'").select("page_id", "path", F.lit(level).alias("depth"), "x0", "y0", "x1", "y1", "ink")
        leaves = done if leaves is None else leaves.unionByName(done)
        if "fits" in regions.columns:
            slanted = regions.filter("slanted").select(*KEYS, "rank", "fits")
            tried = slanted if tried is None else tried.unionByName(slanted)
        parts = children(regions.filter("split <> 'leaf'"))
        if parts.isEmpty():
            break
        live = kept(clip(live, parts))
        dark = None if dark is None else kept(clip(dark, parts))
    return leaves, tried


def xy_cut(runs: DataFrame, maps: DataFrame, depth: int = 6, borders: DataFrame | None = None, shear: bool = True, shear_depth: int = 4, remember: bool = False) -> DataFrame:
    """Leaves (page_id, path, depth, x0, y0, x1, y1, ink) of runs(page_id, y, x0, x1) on maps(page_id, w, h).

    The runs may come as slabs, or as pages(page_id, slabs). Without borders and memory, a task cuts a page down to its leaves;
    with them, levels follow one another, and each is written.

    borders: runs of border cells, where drawn lines are to split. shear: whether slanted bands are, down to shear_depth.
    Without remember, each region tries all slopes in the same order. With it, the slope that split the last region before
    it goes first, regions being visited in depth, first parts before second ones. All regions of a level are still cut at
    once: pages are cut with the slopes that the cut before remembered, at first none, and those pages are cut again of
    which some region would now choose otherwise. Whether a slope splits a region does not depend on which is tried first,
    so each round settles one more slanted split of a page at least; most pages need one or two rounds. Children take the
    trimmed extent of the other axis.
    """
    least = F.least("w", "h")
    limits = maps.select("page_id", F.greatest(F.lit(2), F.floor(least * 0.005)).alias("min_len"), F.greatest(F.lit(2), F.floor(least * 0.01)).alias("max_width"), F.greatest(F.lit(4), F.floor(least * 0.03)).alias("min_side"))
    if borders is None and not (shear and remember):
        pages = packed_slabs(runs).join(limits.select("page_id", "min_len"), "page_id", "left")
        return _page_leaves(pages, depth, shear_depth if shear else -1)
    live = kept(slabs(runs, True).withColumn("path", F.lit("0")))
    dark = None if borders is None else slabs(borders, True).withColumn("path", F.lit("0"))
    if not (shear and remember):
        return _levels(live, dark, limits, depth, shear_depth if shear else -1, None)[0]
    memory = live.limit(0).selectExpr("page_id", "cast(NULL AS array<struct<path:string,rank:int>>) AS slopes")
    settled = None
    for _ in range(1 << (shear_depth + 1)):  # a page has fewer slanted splits
        leaves, tried = _levels(live, dark, limits, depth, shear_depth, memory)
        tried = kept(tried)
        memory = tried.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("path", "rank"))).alias("slopes"))
        other = tried.join(memory, "page_id").withColumn("hint", F.expr(_HINT)).filter("hint <> rank AND (fits & shiftleft(1, hint)) <> 0")
        memory = kept(memory.join(other.select("page_id").distinct(), "page_id", "left_semi"))
        same = leaves.join(memory, "page_id", "left_anti")
        settled = same if settled is None else settled.unionByName(same)
        if memory.isEmpty():
            return settled
        live = kept(live.join(memory, "page_id", "left_semi"))
        dark = None if dark is None else kept(dark.join(memory, "page_id", "left_semi"))
    raise RuntimeError("slopes did not settle")


def _trimmed(own: np.ndarray, slab: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(regions that have ink, their places in it for each slab, their extents and ink), of slabs in the order of their regions."""
    first = np.flatnonzero(np.diff(own, prepend=-1))
    n = np.diff(np.append(first, own.size))
    low = {c: np.minimum.reduceat(slab[c], first) if first.size else first for c in ("x0", "y0")}
    high = {c: np.maximum.reduceat(slab[c], first) if first.size else first for c in ("x1", "y1")}
    area = (slab["x1"] - slab["x0"] + 1) * (slab["y1"] - slab["y0"] + 1)
    return own[first], np.repeat(np.arange(first.size), n), low | high | {"ink": np.add.reduceat(area, first) if first.size else first}


def _straight(own: np.ndarray, slab: dict[str, np.ndarray], box: dict[str, np.ndarray], min_len: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(row_start, row_len, col_start, col_len, with 0 for none; whether some line holds 35 % of its span at most) of each region. See `gutters` and `widest`."""
    out, thin = {}, np.zeros(min_len.size, bool)
    for axis, a, b in (("row", "y", "x"), ("col", "x", "y")):
        n = slab[b + "1"] - slab[b + "0"] + 1
        low = int(slab[a + "0"].min(initial=0))
        room = int(slab[a + "1"].max(initial=0)) - low + 3
        key = np.concatenate([own * room + (slab[a + "0"] - low), own * room + (slab[a + "1"] + 1 - low)])
        order = np.argsort(key)
        key, count = key[order], np.cumsum(np.concatenate([n, -n])[order])
        last = np.flatnonzero(np.diff(key, append=-1))  # of edges at one place the last has the sum
        key, count = key[last], count[last]
        # the sum is 0 again at the end of a region
        region, pos = key // room, key % room + low
        end = np.append(pos[1:], 0) - 1
        span = box[b + "1"] - box[b + "0"] + 1
        some = count > 0
        r, c = region[some], count[some]
        held = np.bincount(r, (end - pos + 1)[some], min_len.size)
        thin |= held < box[a + "1"] - box[a + "0"] + 1
        thin[r[c * 100 <= span[r] * 35]] = True
        inked = count * 1000 > span[region] * 5
        r, begin, size = region[inked], end[inked] + 1, np.append(pos[inked][1:], 0) - end[inked] - 1
        band = np.flatnonzero((np.append(r[1:], -1) == r) & (size >= min_len[r]) & (size > 0))
        best = band[np.lexsort((begin[band], -size[band], r[band]))]
        best = best[np.unique(r[best], return_index=True)[1]]
        out |= {f"{axis}_{c}": np.zeros(min_len.size, np.int64) for c in ("start", "len")}
        out[f"{axis}_start"][r[best]], out[f"{axis}_len"][r[best]] = begin[best], size[best]
    return out, thin


def _leaves(page: np.ndarray, slab: dict[str, np.ndarray], min_len: np.ndarray, depth: int, shear_depth: int) -> dict[str, np.ndarray]:
    """Leaves of many pages, from slabs in the order of their pages; code holds the steps of the path as bits after a 1."""
    done: list[dict[str, np.ndarray]] = []
    at, code, own = np.arange(min_len.size), np.ones(min_len.size, np.int64), page
    for level in range(depth + 1):
        some, own, box = _trimmed(own, slab)
        at, code = at[some], code[some]
        least = min_len[at]
        split, start, size, slanted = (np.zeros(at.size, np.int64) for _ in range(4))  # split: 1 rows, 2 columns
        if level < depth and at.size:
            got, thin = _straight(own, slab, box, least)
            row = (got["row_len"] > 0) & (got["row_len"] >= got["col_len"])
            col = ~row & (got["col_len"] > 0)
            split = np.where(row, 1, np.where(col, 2, 0))
            start, size = np.where(row, got["row_start"], got["col_start"]), np.where(row, got["row_len"], got["col_len"])
            open_ = np.flatnonzero((split == 0) & thin) if level <= shear_depth else at[:0]
            if open_.size:
                number = np.full(at.size, -1)
                number[open_] = np.arange(open_.size)
                of = number[own]
                sides = {c: v[of >= 0] for c, v in slab.items()} | {"region": of[of >= 0]}
                rank, late, lo, n, _ = _first_slanted({c: box[c][open_] for c in ("x0", "y0", "x1", "y1")} | {"min_len": least[open_]}, sides, SLOPES, 2, None)
                hit = rank >= 0
                r = open_[hit]
                split[r], start[r], size[r], slanted[r] = 2 - late[hit], lo[hit], n[hit], 1
        leaf = split == 0
        done.append({"page": at[leaf], "code": code[leaf], "depth": np.full(int(leaf.sum()), level), **{c: v[leaf] for c, v in box.items()}})
        live = np.flatnonzero(~leaf)
        if not live.size:
            break
        # children, as in `children`: of region live[i] they are 2 i and 2 i + 1
        row = split[live] == 1
        before = start[live] + np.where(slanted[live] == 1, size[live], 0) - 1
        after = start[live] + np.where(slanted[live] == 1, 0, size[live])
        ends = {c: np.repeat(box[c][live], 2) for c in ("x0", "y0", "x1", "y1")}
        ends["y1"][::2], ends["x1"][::2] = np.where(row, before, box["y1"][live]), np.where(row, box["x1"][live], before)
        ends["y0"][1::2], ends["x0"][1::2] = np.where(row, after, box["y0"][live]), np.where(row, box["x0"][live], after)
        number = np.full(at.size, -1)
        number[live] = np.arange(live.size)
        kid = np.concatenate([2 * number[own], 2 * number[own] + 1])
        kid_slab = {c: np.concatenate([v, v]) for c, v in slab.items()}
        met = np.flatnonzero(kid >= 0)
        met = met[np.argsort(kid[met], kind="stable")]
        own, slab = kid[met], {c: v[met] for c, v in kid_slab.items()}
        slab = {c: np.maximum(slab[c], ends[c][own]) for c in ("y0", "x0")} | {c: np.minimum(slab[c], ends[c][own]) for c in ("y1", "x1")}
        whole = (slab["y0"] <= slab["y1"]) & (slab["x0"] <= slab["x1"])
        own, slab = own[whole], {c: v[whole] for c, v in slab.items()}
        at, code = np.repeat(at[live], 2), np.repeat(code[live], 2) * 2 + np.tile([0, 1], live.size)
    return {c: np.concatenate([d[c] for d in done]) for c in done[0]}


def _many(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, list[tuple[int, int]]]:
    """(page, slabs, where each page's begin, parts of neighbouring pages that are cut at once)."""
    row, slab = fields(lists, ENDS)
    cost = np.bincount(row, slab["y1"] - slab["y0"] + slab["x1"] - slab["x0"] + 8, len(lists)) + 1200
    return row, slab, np.searchsorted(row, np.arange(len(lists) + 1)), list(parts(cost, PART))


def first_cuts(pages: DataFrame, min_len: int) -> DataFrame:
    """(page_id, x0, y0, x1, y1, ink, row_start, row_len, col_start, col_len): the extent of each page(page_id, slabs) and its widest bands, with a length of 0 for none."""
    kinds = {**dict.fromkeys(("x0", "y0", "x1", "y1"), "int"), "ink": "bigint", **dict.fromkeys(("row_start", "row_len", "col_start", "col_len"), "int")}

    @F.arrow_udf(f"array<struct<{','.join(f'{c}:{t}' for c, t in kinds.items())}>>")
    def of(lists: pa.Array) -> pa.Array:
        row, slab, begin, parts_ = _many(lists)
        got = []
        for a, b in parts_:
            part = {c: v[begin[a] : begin[b]] for c, v in slab.items()}
            some, own, box = _trimmed(row[begin[a] : begin[b]], part)
            got.append({"row": some, **box, **_straight(own, part, box, np.full(some.size, min_len))[0]})
        every = {c: np.concatenate([g[c] for g in got] or [row]) for c in ("row", *kinds)}
        return lists_of(every["row"], len(lists), {c: pa.array(every[c], pa.int64() if t == "bigint" else pa.int32()) for c, t in kinds.items()})

    return pages.select("page_id", F.inline(of("slabs")))


def _page_leaves(pages: DataFrame, depth: int, shear_depth: int) -> DataFrame:
    """Leaves of pages(page_id, slabs, min_len): all levels of a page in one task, many pages at a time, so that nothing is stored between levels."""

    @F.arrow_udf("array<struct<path:string,depth:int,x0:int,y0:int,x1:int,y1:int,ink:bigint>>")
    def of(lists: pa.Array, least: pa.Array) -> pa.Array:
        row, slab, begin, parts_ = _many(lists)
        # without a limit nothing is wide enough
        least = least.cast(pa.int64()).fill_null(1 << 31).to_numpy(zero_copy_only=False)
        got = []
        for a, b in parts_:
            leaves = _leaves(row[begin[a] : begin[b]] - a, {c: v[begin[a] : begin[b]] for c, v in slab.items()}, least[a:b], depth, shear_depth)
            order = np.argsort(leaves["page"], kind="stable")
            got.append({c: v[order] for c, v in leaves.items()} | {"page": leaves["page"][order] + a})
        names = ("page", "code", "depth", "x0", "y0", "x1", "y1", "ink")
        every = {c: np.concatenate([g[c] for g in got] or [row]) for c in names}
        codes, which = np.unique(every["code"], return_inverse=True)
        path = pa.array(["0" + f"{c:b}"[1:] for c in codes.tolist()], pa.string()).take(pa.array(which))
        whole = {"path": path} | {c: pa.array(every[c], pa.int64() if c == "ink" else pa.int32()) for c in names[2:]}
        return lists_of(every["page"], len(lists), whole)

    return pages.select("page_id", F.inline(of("slabs", "min_len")))


def leaf_filter(leaves: DataFrame, maps: DataFrame) -> DataFrame:
    """Without leaves that are too small, and without long thin ones that hold hardly any of the page's ink.

    The page's ink is that of maps(page_id, w, h, ink), gutters included; maps without it keep long thin leaves.
    """
    maps = maps.select("page_id", "w", "h", (F.col("ink") if "ink" in maps.columns else F.lit(0)).alias("page_ink"))
    rows = leaves.join(maps, "page_id").withColumn("lw", F.expr("x1 - x0 + 1")).withColumn("lh", F.expr("y1 - y0 + 1"))
    big = "least(lw, lh) >= greatest(4, floor(least(w, h) * 0.03)) AND lw * lh >= floor(w * h * 0.005)"
    sliver = "greatest(lw, lh) >= 4 * least(lw, lh) AND ink < floor(page_ink * 0.02)"
    return rows.filter(f"{big} AND NOT ({sliver})").select(*leaves.columns)


def to_panels(leaves: DataFrame, maps: DataFrame, most: int = 40, scale_x: Column | float = 1, scale_y: Column | float = 1) -> DataFrame:
    """The first leaves in the order of the recursion as panels(page_id, x, y, w, h) in native units, grown by one cell within the page.

    scale_x, scale_y: native units a cell, which may be columns, as native_w / w. The page ends at native_w and native_h
    of the maps, or at their scaled w and h if there are no such columns.
    """
    sx, sy = (v if isinstance(v, Column) else F.lit(v) for v in (scale_x, scale_y))
    right, bottom = (F.col(f"native_{c}") if f"native_{c}" in maps.columns else F.col(c) * s for c, s in (("w", sx), ("h", sy)))
    first = leaves.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("path"))).filter(F.col("r") <= most)
    at = first.join(maps, "page_id").withColumn("x", F.greatest(F.lit(0), (F.col("x0") - 1) * sx)).withColumn("y", F.greatest(F.lit(0), (F.col("y0") - 1) * sy))
    w, h = F.least(right, (F.col("x1") + 2) * sx) - F.col("x"), F.least(bottom, (F.col("y1") + 2) * sy) - F.col("y")
    return at.select("page_id", "x", "y", F.greatest(F.lit(1), w).alias("pw"), F.greatest(F.lit(1), h).alias("ph")).select("page_id", "x", "y", F.col("pw").alias("w"), F.col("ph").alias("h"))
