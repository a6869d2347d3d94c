"""Word boxes under taps, for a whole table of taps at a time, from the ink runs or the luminance of their pages.

A tap looks at a crop of its page, scaled to a tile. On the tile it snaps to the nearest line of ink, grows that to a
text line, calibrates from the line's own gaps how wide a gap between words is, and grows to the word between two such
gaps. A tap meets its page's ink as a value of one row and is worked out within that row, so nothing is stored but the
join with the pages; the ink is slabs, of which a tile's raster bounds the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import clamp, tile_to_native
from .raster import is_signed_ink, merged_runs, packed_slabs, slabs_of_cells
from .reviews import gap_threshold

#: In native units the reach of a line, of its band and of the background's sample, in heights of a line the others.
HALF_LINE, HALF_BAND, HALF_SAMPLE, SNAP, WINDOW, WIDEST, TALLEST, PAD = 35, 30, 70, 2, 6, 14, 2.5, 0.05
BLANK_LINES = 2


def crop_window(x: Column, y: Column, pw: Column, ph: Column) -> tuple[Column, ...]:
    """(x, y, w, h) of the crop around a tap: 15 % of the page's width and 5 % of its height each way, 40 and 20 at least; null under 4."""
    half_w, half_h = F.greatest(F.lit(40.0), pw * 0.15), F.greatest(F.lit(20.0), ph * 0.05)
    x0, y0 = F.greatest(F.lit(0.0), x - half_w), F.greatest(F.lit(0.0), y - half_h)
    w, h = F.least(pw, x + half_w) - x0, F.least(ph, y + half_h) - y0
    return tuple(F.when((w >= 4) & (h >= 4), c) for c in (x0, y0, w, h))


def tiles(taps: DataFrame, zoom: int = 2) -> DataFrame:
    """`taps(tap_id, page_id, x, y, pw, ph)` with the tile's origin ox, oy, its size tw, th and the tap on it, tx, ty; none where the crop is too small."""
    at = taps.select("tap_id", "page_id", "x", "y", *[c.alias(n) for n, c in zip(("cx", "cy", "cw", "ch"), crop_window(F.col("x"), F.col("y"), F.col("pw"), F.col("ph")), strict=True)])
    corner = [F.floor(F.col(c) * zoom + 0.001).cast("int").alias(n) for c, n in (("cx", "ox"), ("cy", "oy"))]
    size = [F.ceil(F.col(c) * zoom - 0.001).cast("int").alias(n) for c, n in (("cw", "tw"), ("ch", "th"))]
    at = at.filter("cw IS NOT NULL").select("tap_id", "page_id", "x", "y", *corner, *size)
    on = lambda v, o, size: clamp(F.floor(F.col(v) * zoom) - F.col(o), F.lit(0), F.col(size) - 1).cast("int")
    return at.withColumn("tx", on("x", "ox", "tw")).withColumn("ty", on("y", "oy", "th"))


def tile_runs(tiled: DataFrame, runs: DataFrame, zoom: int = 2) -> DataFrame:
    """(tap_id, y, x0, x1): the runs(page_id, y, x0, x1) of each tap's page on its tile, merged within a line."""
    r = runs.select(F.col("page_id").alias("of"), F.col("y").alias("ry"), F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    return merged_runs(_on_tile(tiled.join(r, (F.col("page_id") == F.col("of")) & _meets(zoom)), zoom)).withColumnRenamed("page_id", "tap_id")


def _meets(zoom: int) -> Column:
    """Whether a run or cell (ry, r0, r1) of a page lies on a tile."""
    return F.expr(f"ry * {zoom} + {zoom} - 1 - oy >= 0 AND ry * {zoom} - oy < th AND (r1 + 1) * {zoom} - 1 - ox >= 0 AND r0 * {zoom} - ox < tw")


def _on_tile(met: DataFrame, zoom: int) -> DataFrame:
    """Runs (page_id, y, x0, x1) of tiles, by the tap as page_id, of rows with their tile and a run (ry, r0, r1) of its page."""
    met = met.select("tap_id", "tw", "th", F.explode(F.expr(f"sequence(ry * {zoom} - oy, ry * {zoom} + {zoom} - 1 - oy)")).alias("y"), F.expr(f"greatest(0, r0 * {zoom} - ox)").alias("x0"), F.expr(f"least(tw - 1, (r1 + 1) * {zoom} - 1 - ox)").alias("x1"))
    return met.filter("y BETWEEN 0 AND th - 1").select(F.col("tap_id").alias("page_id"), "y", "x0", "x1")


def _on_tiles(tiled: DataFrame, pages: DataFrame, zoom: int, *more: str) -> DataFrame:
    """`tiled` with ink, the page's slabs on the tile as structs (y0, y1, x0, x1, more) in places of the tile; an empty array where there are none."""
    met = f"s -> s.y1 * {zoom} + {zoom} - 1 - oy >= 0 AND s.y0 * {zoom} - oy < th AND s.x1 * {zoom} + {zoom} - 1 - ox >= 0 AND s.x0 * {zoom} - ox < tw"
    ends = [f"greatest(0, s.{a}0 * {zoom} - o{a}) AS {a}0, least({size} - 1, s.{a}1 * {zoom} + {zoom} - 1 - o{a}) AS {a}1" for a, size in (("y", "th"), ("x", "tw"))]
    on = F.expr(f"transform(filter(slabs, {met}), s -> struct({', '.join(ends + [f's.{c} AS {c}' for c in more])}))")
    of = pages.select(F.col("page_id").alias("of"), "slabs")
    return tiled.join(of, F.col("page_id") == F.col("of"), "left").withColumn("ink", F.when(F.col("slabs").isNotNull(), on).otherwise(F.expr(f"filter({_none(on_more=more)}, x -> false)"))).drop("of", "slabs").transform(_settled)


def _settled(df: DataFrame) -> DataFrame:
    """`df` with its columns as generated values: what follows refers to them, and the optimizer does not put their expressions in their place again and again."""
    return df.select(F.inline(F.array(F.struct("*"))))


def _none(on_more: tuple[str, ...] = ()) -> str:
    return f"array(struct({', '.join(f'0 AS {c}' for c in ('y0', 'y1', 'x0', 'x1', *on_more))}))"


def _background(zoom: int) -> Column:
    """The upper quartile of the luminance around the tap, of tiles with ink(y0, y1, x0, x1, lum); null where there is none.

    Sampled in steps of a 32nd of the sample's shorter side: paper is what most of a bubble is, whatever the art around
    it. A cell counts as often as the sample meets it on the tile.
    """
    lo = {a: f"greatest(0, t{a} - {half * zoom})" for a, half in (("x", HALF_BAND), ("y", HALF_SAMPLE))}
    hi = {a: f"least({size} - 1, t{a} + {half * zoom})" for a, size, half in (("x", "tw", HALF_BAND), ("y", "th", HALF_SAMPLE))}
    step = f"greatest(1, least({hi['x']} - {lo['x']} + 1, {hi['y']} - {lo['y']} + 1) div 32)"
    n = [f"greatest(0, (least(s.{a}1, {hi[a]}) - {lo[a]}) div {step} - (greatest(s.{a}0, {lo[a]}) - {lo[a]} + {step} - 1) div {step} + 1)" for a in ("x", "y")]
    met = " AND ".join(f"s.{a}0 <= {hi[a]} AND s.{a}1 >= {lo[a]}" for a in ("x", "y"))
    counts = f"array_sort(filter(transform(filter(ink, s -> {met}), s -> struct(s.lum AS lum, cast({n[0]} * {n[1]} AS bigint) AS n)), s -> s.n > 0))"
    upto = "aggregate(counts, struct(0L AS seen, cast(NULL AS int) AS lum), (a, s) -> struct(a.seen + s.n AS seen, coalesce(a.lum, if((a.seen + s.n) * 4 >= total * 3, cast(s.lum AS int), NULL)) AS lum), a -> a.lum)"
    # each is bound once, as the argument of a function of one value
    return F.expr(f"element_at(transform(array({counts}), counts -> element_at(transform(array(aggregate(counts, 0L, (a, s) -> a + s.n)), total -> {upto}), 1)), 1)")


def _lit(tiled: DataFrame, cells: DataFrame, zoom: int) -> DataFrame:
    """`tiled` with the cells(page_id, x, y, lum) on them as ink(y0, y1, x0, x1, lum) and their background."""
    return _on_tiles(tiled, slabs_of_cells(cells), zoom, "lum").withColumn("background", _background(zoom)).transform(_settled)


def tile_backgrounds(tiled: DataFrame, cells: DataFrame, zoom: int = 2) -> DataFrame:
    """(tap_id, background, inverted) of `tiled` taps that have any of the cells(of, ry, r0, r1, lum) of their page around them; see `_background`."""
    c = cells.select(F.col("of").alias("page_id"), F.col("ry").alias("y"), F.col("r0").alias("x"), "lum")
    return _lit(tiled, c, zoom).filter("background IS NOT NULL").select("tap_id", "background", (F.col("background") < 128).alias("inverted"))


def nearest_flag(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos): of flagged stretches(keys, x0, x1, origin, limit) the place nearest to the origin, within the limit; the lower of two."""
    o = F.col("origin")
    pos = F.when(o.between(F.col("x0"), F.col("x1")), o).when(F.col("x1") < o, F.col("x1")).otherwise(F.col("x0"))
    near = flags.withColumn("pos", pos).withColumn("far", F.abs(F.col("pos") - o)).filter("far <= limit")
    return near.groupBy(*keys).agg(F.min(F.struct("far", "pos")).alias("b")).select(*keys, "b.pos")


def islands(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, x0, x1, seed): flagged stretches(keys, x0, x1, blank, seed) grown over gaps of fewer than `blank` places."""
    order = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = flags.withColumn("new", F.when(F.col("x0") - reach - 1 >= F.col("blank"), 1).otherwise(0))
    grown = cut.withColumn("i", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grown.groupBy(*keys, "i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("seed").alias("seed")).drop("i")


def island_of_seed(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, x0, x1): the island that holds the seed."""
    return islands(flags, *keys).filter("seed BETWEEN x0 AND x1").drop("seed")


def merged(stretches: DataFrame, *keys: str) -> DataFrame:
    """Stretches(keys, x0, x1) that overlap or touch become one."""
    return islands(stretches.select(*keys, "x0", "x1", F.lit(1).alias("blank"), F.lit(0).alias("seed")), *keys).drop("seed")


def line_gaps(stretches: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap): widths of the blank between merged stretches(keys, x0, x1, lo, hi) within lo and hi, closed on both sides."""
    inside = stretches.filter("x1 >= lo AND x0 <= hi").withColumn("a", F.greatest("x0", "lo")).withColumn("z", F.least("x1", "hi"))
    gap = F.lead("a").over(Window.partitionBy(*keys).orderBy("a")) - F.col("z") - 1
    return inside.withColumn("gap", gap).filter("gap > 0").select(*keys, "gap")


def word_boxes(taps: DataFrame, runs: DataFrame, zoom: int = 2) -> DataFrame:
    """(tap_id, reason, x, y, w, h, gap_threshold, median_gap, line_h, gaps) of `taps(tap_id, page_id, x, y, pw, ph)` on ink `runs(page_id, y, x0, x1)`.

    A tap has a box or a reason why not. gaps are sorted; they and the threshold are null where no line was found. Taps
    whose crop is too small are left out.
    """
    return _found(_on_tiles(tiles(taps, zoom), packed_slabs(runs), zoom), zoom)


def word_boxes_of_cells(taps: DataFrame, cells: DataFrame, zoom: int = 2) -> DataFrame:
    """As word_boxes, from the luminance of cells(page_id, x, y, lum), or pages of them (see `slabs_of_cells`): each tap has its own background, dark on light or light on dark.

    Cells that are missing are no ink and do not count for the background; each cell comes once.
    """
    t = _lit(tiles(taps, zoom), cells, zoom)
    inked = F.filter("ink", lambda s: F.coalesce(is_signed_ink(s.lum, F.col("background"), F.col("background") < 128), F.lit(False)))
    return _found(t.withColumn("ink", inked), zoom)


def _nearest(stretches: str, origin: str, limit: str) -> Column:
    """Of an array of stretches (a, z) the place nearest to the origin, within the limit, the lower of two; null without one."""
    pos = f"CASE WHEN {origin} BETWEEN s.a AND s.z THEN {origin} WHEN s.z < {origin} THEN s.z ELSE s.a END"
    return F.expr(f"array_min(filter(transform(transform({stretches}, s -> {pos}), p -> struct(abs(p - {origin}) AS far, p AS pos)), p -> p.far <= {limit})).pos")


def _island(stretches: str, blank: str, seed: str) -> Column:
    """The stretch (a, z) that holds the seed, of an array of stretches grown over gaps of fewer than `blank` places; the seed lies on one of them."""
    grown = f"CASE WHEN i.a IS NULL THEN s WHEN s.a - i.z - 1 < {blank} THEN struct(i.a AS a, greatest(i.z, s.z) AS z) WHEN i.z >= {seed} THEN i ELSE s END"
    return F.expr(f"aggregate(array_sort({stretches}), struct(cast(NULL AS int) AS a, cast(NULL AS int) AS z), (i, s) -> {grown})")


#: An array of stretches `x`, of which those that overlap or touch become one.
_MERGED = """aggregate(array_sort({x}), cast(array() AS array<struct<a:int,z:int>>), (m, s) -> CASE WHEN size(m) = 0 OR s.a - element_at(m, -1).z > 1 THEN concat(m, array(s))
  ELSE concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a AS a, greatest(element_at(m, -1).z, s.z) AS z))) END)"""


def _found(t: DataFrame, zoom: int) -> DataFrame:
    """Boxes or reasons of tiles with ink(y0, y1, x0, x1) on them, each worked out within its row."""
    half, band = HALF_LINE * zoom, HALF_BAND * zoom
    lines = lambda lo, hi, where="true": f"transform(filter(ink, s -> s.y1 >= {lo} AND s.y0 <= {hi} AND {where}), s -> struct(cast(greatest(s.y0, {lo}) AS int) AS a, cast(least(s.y1, {hi}) AS int) AS z))"
    at = t.withColumn("rows", F.expr(lines(f"(ty - {2 * half})", f"(ty + {2 * half})", f"s.x1 >= greatest(0, tx - {band}) AND s.x0 <= least(tw - 1, tx + {band})")))
    at = _settled(_settled(at).withColumn("ys", _nearest("rows", "ty", str(half))))
    around = f"transform(filter(rows, s -> s.z >= greatest(0, ys - {half}) AND s.a <= least(th - 1, ys + {half})), s -> struct(greatest(s.a, 0, ys - {half}) AS a, least(s.z, th - 1, ys + {half}) AS z))"
    at = at.withColumn("line", F.when(F.col("ys").isNotNull(), _island(around, str(BLANK_LINES), "ys"))).withColumns({"y0": F.col("line.a"), "y1": F.col("line.z"), "line_h": F.expr("line.z - line.a + 1")})
    at = _settled(at.drop("rows", "line"))

    columns = "transform(filter(ink, s -> s.y1 >= y0 AND s.y0 <= y1), s -> struct(cast(s.x0 AS int) AS a, cast(s.x1 AS int) AS z))"
    at = _settled(at.withColumn("cols", F.expr(_MERGED.format(x=columns))))
    at = at.withColumn("xs", _nearest("cols", "tx", f"greatest(4, line_h * {SNAP})"))
    at = at.withColumns({"lo": F.expr(f"greatest(0, xs - line_h * {WINDOW})"), "hi": F.expr(f"least(tw - 1, xs + line_h * {WINDOW})")})
    at = _settled(at).withColumn("inside", F.expr("transform(filter(cols, s -> s.z >= lo AND s.a <= hi), s -> struct(greatest(s.a, lo) AS a, least(s.z, hi) AS z))"))
    between = "if(size(inside) > 1, transform(sequence(2, size(inside)), i -> inside[i - 1].a - inside[i - 2].z - 1), cast(array() AS array<int>))"
    at = at.withColumn("gaps", F.when(F.col("xs").isNotNull(), F.expr(f"array_sort(filter({between}, g -> g > 0))")))
    at = _settled(at.drop("inside", "lo", "hi"))
    at = at.withColumn("gap_threshold", F.when(F.col("xs").isNotNull(), gap_threshold(F.col("gaps"), F.col("line_h")).cast("int")))
    at = at.withColumn("median_gap", F.expr("if(size(gaps) >= 2, (gaps[cast((size(gaps) - 1) div 2 AS int)] + gaps[cast(size(gaps) div 2 AS int)]) / 2, cast(NULL AS double))"))
    at = _settled(at).withColumn("word", F.when(F.col("xs").isNotNull(), _island("cols", "gap_threshold", "xs"))).withColumns({"wx0": F.col("word.a"), "wx1": F.col("word.z")})
    at = _settled(at.drop("word", "cols"))
    at = at.withColumn("own", F.when(F.col("xs").isNotNull(), F.expr(lines(f"greatest(0, ys - {half})", f"least(th - 1, ys + {half})", "s.x1 >= wx0 AND s.x0 <= wx1"))))
    at = _settled(_settled(at.drop("ink")).withColumn("seed", _nearest("own", "ys", "line_h")))
    at = at.withColumn("tall", F.when(F.col("seed").isNotNull(), _island("own", str(BLANK_LINES), "seed")))
    runaway = F.expr("tall.z - tall.a") > F.expr("y1 - y0") * TALLEST
    at = at.withColumn("top", F.when(runaway, F.col("y0")).otherwise(F.col("tall.a"))).withColumn("bottom", F.when(runaway, F.col("y1")).otherwise(F.col("tall.z")))
    every = _settled(at.drop("own", "tall")).withColumn("line_h", F.when(F.col("xs").isNotNull(), F.col("line_h")))
    #: The reasons.
    reason = (
        F.when(F.col("ys").isNull(), "no ink near the tap row")
        .when(F.col("wx0").isNull(), "no ink near the tap column")
        .when(F.col("wx0") <= 0, "ink runs off the left edge of the crop")
        .when(F.col("wx1") >= F.col("tw") - 1, "ink runs off the right edge of the crop")
        .when(F.expr("wx1 - wx0 + 1") > F.col("line_h") * WIDEST, "box too wide for one word")
        .when(F.col("top").isNull(), "no ink in the word's own columns")
    )
    high = F.expr("bottom - top + 1")
    pad_x, pad_y = F.floor(high * PAD * 0.5), F.floor(high * PAD)
    px0, py0 = F.greatest(F.lit(0), F.col("wx0") - pad_x), F.greatest(F.lit(0), F.col("top") - pad_y)
    pw, ph = F.least(F.col("tw") - 1, F.col("wx1") + pad_x) - px0 + 1, F.least(F.col("th") - 1, F.col("bottom") + pad_y) - py0 + 1
    box = tile_to_native((px0, py0, pw, ph), float(zoom), F.col("ox"), F.col("oy"))
    every = every.withColumn("reason", reason)
    return _settled(every).select("tap_id", "reason", *[F.when(F.col("reason").isNull(), c).alias(n) for n, c in zip("xywh", box, strict=True)], "gap_threshold", "median_gap", "line_h", "gaps")
