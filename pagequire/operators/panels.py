"""Panels of pages: which results to trust, reading order, and what lies next to what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import box, contains
from .ordered import laid, neighbours


def accept(pages: DataFrame, panels: DataFrame, one: float = 0.6, bounds: float = 0.4, kept: float = 0.5) -> DataFrame:
    """(page_id, accepted, reason, n_panels, total_area): whether the panels(page_id, x, y, w, h) of pages(page_id, pw, ph) can be trusted.

    No panel: no. One: only if it takes up most of the page. More: their bounding box must cover enough of the page and
    their areas, overlaps counted twice, enough of that box.
    """
    area = F.col("w") * F.col("h")
    sums = panels.groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(area).alias("total"), F.max(area).alias("largest"),
        ((F.max(F.col("x") + F.col("w")) - F.min("x")) * (F.max(F.col("y") + F.col("h")) - F.min("y"))).alias("bbox"),
    )
    page = F.col("pw") * F.col("ph")
    full = pages.join(sums, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.floor(F.try_divide(F.col("total") * 100, F.col("bbox"))).cast("string")
    reason = (
        F.when(F.col("n") == 0, "no panels")
        .when((F.col("n") == 1) & (F.col("largest") < one * page), "single partial panel")
        .when((F.col("n") > 1) & (F.col("bbox") < bounds * page), "panels cover too little of the page")
        .when((F.col("n") > 1) & (F.col("total") < kept * F.col("bbox")), F.concat(F.lit("only "), share, F.lit("% of the covered area kept")))
    )
    return full.withColumn("reason", reason).select("page_id", F.col("reason").isNull().alias("accepted"), "reason", F.col("n").alias("n_panels"), F.coalesce("total", F.lit(0)).alias("total_area"))


def reading_order(panels: DataFrame, manga: bool = True) -> DataFrame:
    """Adds row_idx and panel_idx, from 1, to integer panels(page_id, x, y, w, h).

    Panels whose centres are within 0.45 of the larger height are in one row, and so are all that such steps connect.
    Sorted by centre, a row ends where everything so far reaches less far down than the next centre, and everything to
    come less far up than the last one; so two running extremes find the rows without a graph. Rows go by mean centre,
    panels within one from right to left (manga) or left to right; ties by y, x, w, h.
    """
    c, reach = 10 * (2 * F.col("y") + F.col("h")), 9 * F.col("h")  # 20 x centre, 20 x 0.45 x height
    rows = panels.withColumn("c", c).withColumn("lo", c - reach).withColumn("hi", c + reach)
    order = Window.partitionBy("page_id").orderBy("c", "y", "x", "w", "h")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    cut = (F.col("c") > F.max("hi").over(back)) & (F.lag("c").over(order) < F.min("lo").over(ahead))
    rows = rows.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn("line", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("mean", F.avg("c").over(Window.partitionBy("page_id", "line")))
    side = F.col("x").desc() if manga else F.col("x").asc()
    place = Window.partitionBy("page_id").orderBy("mean", "line", side, "y", "w", "h")
    return rows.withColumn("row_idx", (F.col("line") + 1).cast("int")).withColumn("panel_idx", F.row_number().over(place)).drop("c", "lo", "hi", "cut", "line", "mean")


def start_index(panels: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, start_idx): the first panel that contains a point(point_id, page_id, px, py), else the one with the nearest centre, else 1."""
    inside = contains(F.col("px"), F.col("py"), box())
    dist = F.pow(F.col("px") - F.col("x") - F.col("w") / 2, 2) + F.pow(F.col("py") - F.col("y") - F.col("h") / 2, 2)
    rank = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(dist).alias("d"), F.col("panel_idx"))
    met = points.join(panels, "page_id").groupBy("point_id").agg(F.min(rank).alias("r"))
    return points.select("point_id").join(met, "point_id", "left").select("point_id", F.coalesce("r.panel_idx", F.lit(1)).alias("start_idx"))


def uncovered(points: DataFrame, panels: DataFrame) -> DataFrame:
    """Points(page_id, px, py, ...) in no panel of their page."""
    p = panels.select(F.col("page_id").alias("of"), *[F.col(c).alias("p_" + c) for c in ("x", "y", "w", "h")])
    return points.join(p, (F.col("page_id") == F.col("of")) & contains(F.col("px"), F.col("py"), box("p_")), "left_anti")


def panel_sequence(pages: DataFrame, panels: DataFrame) -> DataFrame:
    """Each panel(page_id, panel_idx) with the next and the last one of its doc, over page ends; a page without panels is a stop of its own.

    Stops are dealt by ranges of doc and page, and ranges exchange the rows at their ends, so a doc may be of any length.
    """
    stops = pages.select("doc", "page_id").join(panels.select("page_id", "panel_idx"), "page_id", "left")
    beside = [{n + c: c for c in ("page_id", "panel_idx")} for n in ("prev_", "next_")]
    return neighbours(laid(stops, ["doc"], ["page_id", "panel_idx"]), ["doc"], *beside).select("doc", "page_id", "panel_idx", *beside[1], *beside[0])


def dispatch(detector: str, verdicts: DataFrame, panels: DataFrame, fallback: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Panels by detector: fast keeps accepted pages, auto takes the fallback's panels for the others, exact the fallback's only.

    fallback: panels of pages, or another detector, which gets the verdicts of the pages that it is to look at: of those that
    were not accepted, a null among them, or of all for exact.
    """
    if callable(fallback):
        fallback = fallback(verdicts if detector == "exact" else verdicts.filter("NOT coalesce(accepted, false)")) if detector != "fast" else None
    good = panels.join(verdicts.filter("accepted").select("page_id"), "page_id", "left_semi")
    if detector == "fast" or fallback is None:
        return good if detector != "exact" else panels.limit(0)
    return fallback if detector == "exact" else good.unionByName(fallback.join(verdicts.filter("accepted").select("page_id"), "page_id", "left_anti"))


def missing(requests: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Requests(keys, hold) to detect: those without a result; an empty result does not count when the page is held."""
    known = results.select(*[F.col(k).alias("k_" + k) for k in keys], "n_panels")
    same = [F.col(k) == F.col("k_" + k) for k in keys]
    return requests.join(known, [*same, (F.col("n_panels") > 0) | ~F.col("hold")], "left_anti")


def retain_recent(writes: DataFrame, n: int = 12) -> DataFrame:
    """(doc, key, ts): the n keys of each doc that were written last; a later write of a key counts."""
    last = writes.groupBy("doc", "key").agg(F.max("ts").alias("ts"))
    return last.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("ts"), "key"))).filter(F.col("r") <= n).drop("r")


def key_collisions(boxes: DataFrame) -> DataFrame:
    """(key, n): concatenations of page, x, y, w, h without separators that more than one distinct box has."""
    key = F.concat(*[F.col(c).cast("string") for c in ("page_id", "x", "y", "w", "h")])
    return boxes.groupBy(key.alias("key")).agg(F.count_distinct("page_id", "x", "y", "w", "h").alias("n")).filter("n > 1")
