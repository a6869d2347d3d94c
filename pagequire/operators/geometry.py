"""Rectangles over tables: columns x, y, w, h, in one coordinate space for each table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def centre(rect: Sequence[Column]) -> tuple[Column, Column]:
    x, y, w, h = rect
    return x + w / 2, y + h / 2


def rect_key(rect: Sequence[Column]) -> Column:
    """The floored x:y:w:h of a rectangle."""
    return F.concat_ws(":", *[F.floor(c).cast("string") for c in rect])


def from_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """A rectangle that is given by its edges, as x, y, w, h."""
    return x0, y0, x1 - x0, y1 - y0


def evidence_region(tap: Sequence[Column], own: Sequence[Column], user: Sequence[Column], pw: Column, ph: Column) -> tuple[Column, ...]:
    """What to show of a page for a review: the found box, or 20 x 10 around the tap, with the user's box, each side padded by its size, 20 at least, within the page; null under 4."""
    x, y = tap
    edges = lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3])
    near = (x - 20, y - 10, x + 20, y + 10)
    base = [F.coalesce(a, b) for a, b in zip(edges(own), near, strict=True)]
    x0, y0, x1, y1 = (f(a, b) for f, a, b in zip((F.least, F.least, F.greatest, F.greatest), base, edges(user), strict=True))
    pad_x, pad_y = F.greatest(F.lit(20.0), x1 - x0), F.greatest(F.lit(20.0), y1 - y0)
    cx, cy = F.greatest(F.lit(0.0), x0 - pad_x), F.greatest(F.lit(0.0), y0 - pad_y)
    w, h = F.least(pw, x1 + pad_x) - cx, F.least(ph, y1 + pad_y) - cy
    return tuple(F.when((w >= 4) & (h >= 4), c) for c in (cx, cy, w, h))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def contains(x: Column, y: Column, rect: Sequence[Column]) -> Column:
    """Point in rectangle, all four sides included."""
    rx, ry, rw, rh = rect
    return x.between(rx, rx + rw) & y.between(ry, ry + rh)


def either(prefix: str = "") -> tuple[Column, ...]:
    """A box of rows that hold it as x, y, w, h, or else as the edges x0, y0, x1, y1; what is there first counts, corner and size apart."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("x"), c("x0")), F.coalesce(c("y"), c("y0")), F.coalesce(c("w"), c("x1") - c("x0")), F.coalesce(c("h"), c("y1") - c("y0"))


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two rectangles share; 0 if disjoint or absent."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.coalesce(F.when((w > 0) & (h > 0), w * h), F.lit(0))


def anomalous(rect: Sequence[Column], cw: Column, ch: Column, share: float = 0.6) -> Column:
    """A box that takes up most of its crop; false where a side is not positive."""
    _, _, w, h = rect
    return F.coalesce((w > 0) & (h > 0) & (cw > 0) & (ch > 0) & (F.try_divide(w * h, cw * ch) >= share), F.lit(False))


def full_page(rect: Sequence[Column], pw: Column, ph: Column, share: float = 0.92) -> Column:
    return F.coalesce((pw > 0) & (ph > 0) & (rect[2] * rect[3] >= share * pw * ph), F.lit(False))


def overflows(iw: Column, ih: Column, vw: Column, vh: Column) -> Column:
    """A picture that is larger than its viewport by more than one pixel either way."""
    return (iw > vw + 1) | (ih > vh + 1)


def rect_union(rects: DataFrame, *keys: str) -> DataFrame:
    """The bounding box of each group of rectangles."""
    out = rects.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return out.select(*keys, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def dedupe_rects(rects: DataFrame, *keys: str) -> DataFrame:
    """One rectangle for each floored x:y:w:h within the keys, without empty ones."""
    floored = [F.floor(c).alias(n) for n, c in zip(BOX, box(), strict=True)]
    return rects.filter("w > 0 AND h > 0").select(*keys, *floored).dropDuplicates([*keys, *BOX])


def crop_rect(mode: str, rect: Sequence[Column], pw: Column, ph: Column, ratio: float = 0.08, least: float = 8) -> tuple[Column, ...]:
    """Strict and margin crops keep the rectangle; loose ones grow it on each side and stop at the page's edge; for none see viewport_box."""
    x, y, w, h = rect
    if mode == "none":
        raise ValueError("a crop of mode none follows the screen: take viewport_box")
    if mode != "loose":
        return rect
    bleed = F.greatest(F.lit(float(least)), F.greatest(w, h) * ratio)
    x0, y0 = F.greatest(F.lit(0.0), x - bleed), F.greatest(F.lit(0.0), y - bleed)
    return x0, y0, F.least(pw, x + w + bleed) - x0, F.least(ph, y + h + bleed) - y0


def fit_zoom(w: Column, h: Column, sw: Column, sh: Column) -> Column:
    return F.least(sw / w, sh / h)


def viewport_box(rect: Sequence[Column], pw: Column, ph: Column, sw: Column, sh: Column) -> dict[str, Column]:
    """The part of the page that a screen shows around a rectangle at the zoom that fits it, and where to paste it."""
    x, y, w, h = rect
    scale = fit_zoom(w, h, sw, sh)
    bw, bh = sw / scale, sh / scale
    bx, by = x + w / 2 - bw / 2, y + h / 2 - bh / 2
    ux, uy = F.greatest(F.lit(0.0), bx), F.greatest(F.lit(0.0), by)
    return {
        "scale": scale, "ux": ux, "uy": uy, "uw": F.least(pw, bx + bw) - ux, "uh": F.least(ph, by + bh) - uy,
        "paste_x": F.floor((ux - bx) * scale + 0.5), "paste_y": F.floor((uy - by) * scale + 0.5),
    }


def margin_factor(mode: Column, full: Column, ratio: Column) -> Column:
    """How far a margin crop shrinks its panel on the screen; null where it does not."""
    return F.when((mode == "margin") & ~full & (ratio > 0), 1 - F.least(F.lit(0.9), ratio))


def pad_box(rect: Sequence[Column], ratio: float, pw: Column, ph: Column) -> tuple[Column, ...]:
    """A box grown by a share of its height, at least 1, within the page."""
    x, y, w, h = rect
    m = F.greatest(F.lit(1.0), h * ratio)
    x0, y0 = F.greatest(F.lit(0.0), x - m), F.greatest(F.lit(0.0), y - m)
    return x0, y0, F.least(pw, x + w + m) - x0, F.least(ph, y + h + m) - y0


def corners_to_box(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """A box from two corners in any order; null where a side is under 1."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    ok = (w >= 1) & (h >= 1)
    return tuple(F.when(ok, c) for c in (F.least(x0, x1), F.least(y0, y1), w, h))


def native_to_tile(rect: Sequence[Column], zoom: float, ox: Column, oy: Column) -> tuple[Column, ...]:
    """Native units to tile pixels; the origin is the floored corner of the scaled crop."""
    x, y, w, h = rect
    size = lambda v: F.greatest(F.lit(1), F.floor(v * zoom + 0.5))
    return F.floor(x * zoom + 0.001) - ox, F.floor(y * zoom + 0.001) - oy, size(w), size(h)


def tile_to_native(rect: Sequence[Column], zoom: float, ox: Column, oy: Column) -> tuple[Column, ...]:
    x, y, w, h = rect
    return (ox + x) / zoom, (oy + y) / zoom, w / zoom, h / zoom


def screen_to_page(x: Column, y: Column, crop: Sequence[Column], bw: Column, bh: Column, left: Column, top: Column, rotated: Column) -> tuple[Column, Column]:
    """A point on the screen to the page: without origin and pan, as a share of the picture within 0 and 1, turned back, within the crop."""
    cx, cy, cw, ch = crop
    u, v = (clamp(F.coalesce(F.try_divide(p, s), F.lit(0.0)), F.lit(0.0), F.lit(1.0)) for p, s in ((x - left, bw), (y - top, bh)))
    px = F.when(rotated == 90, v).when(rotated == 180, 1 - u).when(rotated == 270, 1 - v).otherwise(u)
    py = F.when(rotated == 90, 1 - u).when(rotated == 180, 1 - v).when(rotated == 270, u).otherwise(v)
    return cx + px * cw, cy + py * ch


def page_to_screen(rect: Sequence[Column], crop: Sequence[Column], bw: Column, bh: Column, left: Column, top: Column, rotated: Column) -> tuple[Column, ...]:
    """A box on the page to the screen, clipped to the crop; null where they do not meet."""
    x, y, w, h = rect
    cx, cy, cw, ch = crop
    x0, y0 = F.greatest(x, cx), F.greatest(y, cy)
    x1, y1 = F.least(x + w, cx + cw), F.least(y + h, cy + ch)
    ok = (x1 > x0) & (y1 > y0) & (cw > 0) & (ch > 0)
    u0, u1, v0, v1 = (F.try_divide(a - b, s) for a, b, s in ((x0, cx, cw), (x1, cx, cw), (y0, cy, ch), (y1, cy, ch)))
    turn = lambda a, b, c, d: F.when(rotated == 90, a).when(rotated == 180, b).when(rotated == 270, c).otherwise(d)
    sx, sy = turn(1 - v1, 1 - u1, v0, u0) * bw + left, turn(u0, 1 - v1, 1 - u1, v0) * bh + top
    sw, sh = turn(v1 - v0, u1 - u0, v1 - v0, u1 - u0) * bw, turn(u1 - u0, v1 - v0, u1 - u0, v1 - v0) * bh
    size = lambda s: F.greatest(F.lit(1), F.ceil(s))
    return tuple(F.when(ok, c.cast("long")) for c in (F.floor(sx), F.floor(sy), size(sw), size(sh)))


def grid_points(pages: DataFrame, cols: int = 4, rows: int = 7) -> DataFrame:
    """(page_id, ord, x, y): where to probe `pages(page_id, pw, ph, hold_x, hold_y, manga)`, in the order of probing.

    The hold point, the centre cell, the first column in reading direction downwards, the centre row in reading
    direction, then the whole grid row by row; points on one floored place count once, where they come first.
    """
    mid_c, mid_r = (cols + 1) // 2, (rows + 1) // 2
    plan = [(mid_c, mid_r, mid_c, mid_r)]
    plan += [(1, r, cols, r) for r in range(1, rows + 1)]
    plan += [(c, mid_r, cols + 1 - c, mid_r) for c in range(1, cols + 1)]
    plan += [(c, r, c, r) for r in range(1, rows + 1) for c in range(1, cols + 1)]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.when(F.col("manga"), m).otherwise(c).alias("c"), F.lit(r).alias("r")) for i, (c, r, m, _) in enumerate(plan)])
    at = pages.withColumn("p", F.explode(cells))
    grid = at.select("page_id", F.col("p.ord").alias("ord"), (F.col("pw") * (F.col("p.c") - 0.5) / cols).alias("x"), (F.col("ph") * (F.col("p.r") - 0.5) / rows).alias("y"))
    hold = pages.filter("hold_x IS NOT NULL AND hold_y IS NOT NULL").select("page_id", F.lit(0).alias("ord"), F.col("hold_x").cast("double").alias("x"), F.col("hold_y").cast("double").alias("y"))
    return dedupe_points(hold.unionByName(grid))


def dedupe_points(points: DataFrame) -> DataFrame:
    """One point for each page and floored place: the first in order."""
    first = points.groupBy("page_id", F.floor("x").alias("fx"), F.floor("y").alias("fy")).agg(F.min(F.struct("ord", "x", "y")).alias("p"))
    return first.select("page_id", "p.ord", "p.x", "p.y")
