"""Operators against literal loops on small random pages, and logs and streams against their batch forms."""

import json
import math
import os
import random
import struct
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagequire.functions import text
from pagequire.operators import cut, geometry, nav, ordered, panels, raster, reviews, settings, words
from pagequire.plans import queries
from pagequire.sources import logs
from pagequire.streaming import streams

R = random.Random(11)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def cut_brute(cells, w, h, depth=6, dark=None, shear=True, remember=False):
    """(leaves, how regions were split), a region of one page after another."""
    out, ways, last = [], [], []
    small = min(w, h)
    least, widest, side = max(2, int(small * 0.005)), max(2, int(small * 0.01)), max(4, int(small * 0.03))

    def bands(counts, span):
        pos = [p for p in sorted(counts) if counts[p] * 1000 > span * 5]
        return sorted(((b - a - 1, a + 1) for a, b in zip(pos, pos[1:]) if b - a - 1 >= least), key=lambda g: (-g[0], g[1]))

    def stroke(counts, lo, hi, span):
        best, run = (0, None), []
        for p in range(lo, hi + 2):
            if p <= hi and counts.get(p, 0) * 100 >= span * 97:
                run.append(p)
                continue
            if run and run[0] > lo and run[-1] < hi and len(run) <= widest and run[0] - lo >= side and hi - run[-1] >= side and (not best[0] or len(run) < best[0]):
                best = (len(run), run[0])
            run = []
        return best

    def slanted(ink, x0, x1, y0, y1):
        for slope in last[-1:] * remember + list(cut.SLOPES):
            for axis, (lo, hi), (a0, a1), place in (("col", (x0, x1), (y0, y1), lambda p: p), ("row", (y0, y1), (x0, x1), lambda p: p[::-1])):
                counts, mid, size = Counter(), math.floor((a0 + a1) / 2), a1 - a0 + 1
                for p in ink:
                    b, at = place(p)
                    to = b - math.floor(slope * (at - mid) + 0.5)
                    if (at - a0) % 2 == 0 and lo <= to <= hi:
                        counts[to] += 1
                drift = math.floor(abs(slope) * size / 2) + 1
                for n, start in bands(counts, size / 2):
                    if start - drift > lo and start + n - 1 + drift < hi:
                        last.append(slope)
                        return axis, start - drift, start + n - 1 + drift
        return None

    def go(x0, y0, x1, y1, path):
        ink = [p for p in cells if x0 <= p[0] <= x1 and y0 <= p[1] <= y1]
        if not ink:
            return
        x0, x1 = min(x for x, _ in ink), max(x for x, _ in ink)
        y0, y1 = min(y for _, y in ink), max(y for _, y in ink)
        row, col = Counter(y for _, y in ink), Counter(x for x, _ in ink)
        wide, high = x1 - x0 + 1, y1 - y0 + 1
        if len(path) - 1 < depth:
            (rl, rs), (cl, cs) = (bands(row, wide) + [(0, None)])[0], (bands(col, high) + [(0, None)])[0]
            how = ("row", rs, rl) if rl and rl >= cl else ("col", cs, cl) if cl else None
            if not how and dark is not None:
                at = [p for p in dark if x0 <= p[0] <= x1 and y0 <= p[1] <= y1]
                (rl, rs), (cl, cs) = stroke(Counter(y for _, y in at), y0, y1, wide), stroke(Counter(x for x, _ in at), x0, x1, high)
                how = ("row", rs, rl) if rl and (not cl or rl <= cl) else ("col", cs, cl) if cl else None
                ways.extend(["drawn"] if how else [])
            if how:
                axis, start, n = how
                go(x0, y0, *((x1, start - 1) if axis == "row" else (start - 1, y1)), path + "0")
                return go(*((x0, start + n) if axis == "row" else (start + n, y0)), x1, y1, path + "1")
            thin = min(col[x] for x in range(x0, x1 + 1)) * 100 <= high * 35 or min(row[y] for y in range(y0, y1 + 1)) * 100 <= wide * 35
            if shear and len(path) - 1 <= 4 and thin and (found := slanted(ink, x0, x1, y0, y1)):
                ways.append("slanted " + found[0])
                axis, lo, hi = found
                go(x0, y0, *((x1, hi) if axis == "row" else (hi, y1)), path + "0")
                return go(*((x0, lo) if axis == "row" else (lo, y0)), x1, y1, path + "1")
        out.append((path, len(path) - 1, x0, y0, x1, y1, len(ink)))

    go(0, 0, w - 1, h - 1, "0")
    return out, ways


def ink_runs(spark, pages):
    runs = [(page, y, x, x) for page, ink in pages.items() for x, y in ink]
    return raster.merged_runs(spark.createDataFrame(runs, "page_id long, y int, x0 int, x1 int"))


@pytest.mark.parametrize("shear, drawn", [(False, False), (True, False), (True, True)])
def test_xy_cut_equals_a_loop(spark, shear, drawn):
    r = random.Random(21)
    pages, dark, want, ways = {}, {}, [], Counter()
    for page in range(24):
        ink = set()
        for _ in range(r.randrange(1, 7)):
            x, y = r.randrange(34), r.randrange(34)
            ink |= {(x + i, y + j) for i in range(r.randrange(1, 12)) for j in range(r.randrange(1, 12))}
        if page % 3 == 1:  # two parts with a slanted band between them
            slope, flip = r.choice([0.06, -0.09, 0.12, -0.14]), r.random() < 0.5
            ink = {(y, x) if flip else (x, y) for x in range(2, 46) for y in range(3, 45) if abs(x - 24 - slope * (y - 24)) > 2.5}
        if page % 3 == 2:  # filled, with a drawn line
            at, flip = r.randrange(12, 34), r.random() < 0.5
            ink = {(x, y) for x in range(1, 47) for y in range(1, 47)}
            dark[page] = {p for p in ink if p[flip] in (at, at + 1)}
        pages[page] = ink
        leaves, how = cut_brute(ink, 48, 48, dark=dark.get(page, set()) if drawn else None, shear=shear)
        want += [(page, *leaf) for leaf in leaves]
        ways.update(how)
    maps = spark.range(24).selectExpr("id AS page_id", "48 AS w", "48 AS h")
    got = cut.xy_cut(ink_runs(spark, pages), maps, shear=shear, borders=ink_runs(spark, dark) if drawn else None)
    assert rows(got) == sorted(want)
    assert set(ways) >= ({"slanted col", "slanted row"} if shear else set()) | ({"drawn"} if drawn else set())


def test_slopes_of_a_page_are_remembered_as_by_a_loop(spark):
    """Pages of three to five parts: a narrow band that few slopes fit, then wider ones that many do."""
    r = random.Random(2)
    pages, want, other, ways = {}, [], set(), Counter()
    for page in range(24):
        flip, n = r.random() < 0.5, r.randrange(2, 5)
        bands = [(60 * (i + 1) / (n + 1), r.choice(cut.SLOPES[2 * (i == 0) :]), r.choice([1.5, 2.5]) if i == 0 else r.choice([2.5, 4, 5])) for i in range(n)]
        ink = {(x, y) for x in range(1, 59) for y in range(1, 59) if not any(abs(x - at - s * (y - 30)) <= b for at, s, b in bands)}
        pages[page] = {(y, x) if flip else (x, y) for x, y in ink}
        leaves, how = cut_brute(pages[page], 60, 60, depth=3, remember=True)
        want += [(page, *leaf) for leaf in leaves]
        other |= {page} if leaves != cut_brute(pages[page], 60, 60, depth=3)[0] else set()
        ways.update(how)
    maps = spark.range(24).selectExpr("id AS page_id", "60 AS w", "60 AS h")
    assert rows(cut.xy_cut(ink_runs(spark, pages), maps, depth=3, remember=True)) == sorted(want)
    assert len(other) > 3 and ways["slanted col"] and ways["slanted row"]


def test_slanted_bands_in_parts_and_with_hints(spark, monkeypatch):
    """Bands do not depend on how regions are put together; a hint goes first; every slope that fits has its bit; a column that both inputs have does no harm."""
    r = random.Random(5)
    pages = {}
    for page in range(30):
        s, b, flip = r.choice(cut.SLOPES), r.choice([2.5, 4, 6]), r.random() < 0.5
        ink = {(x, y) for x in range(2, 50) for y in range(2, 50) if abs(x - 25 - s * (y - 25)) > b or page % 5 == 0}
        pages[page] = {(y, x) if flip else (x, y) for x, y in ink}
    ink = raster.slabs(ink_runs(spark, pages), True).withColumn("extra", F.lit(1))
    boxes = cut.trim(ink, "page_id").withColumns({"min_len": F.lit(2), "extra": F.lit("a")})
    want = rows(cut.sheared(ink, boxes, "page_id"))
    assert 0 < len(want) <= 24
    monkeypatch.setattr(cut, "PART", 1)
    assert rows(cut.sheared(ink, boxes, "page_id")) == want
    one_by_one = {i: {t[0]: t[1:] for t in rows(cut.sheared(ink, boxes, "page_id", slopes=[slope]))} for i, slope in list(enumerate(cut.SLOPES))[:4]}
    hints = boxes.withColumn("hint", F.expr("if(page_id % 2 = 0, 3, null)"))
    got = {t["page_id"]: t for t in cut.sheared(ink, hints, "page_id").collect()}
    assert set(got) == {t[0] for t in want}
    for page, t in got.items():
        assert all(bool(t["fits"] >> i & 1) == (page in found) for i, found in one_by_one.items())
        least = min(i for i in range(len(cut.SLOPES)) if t["fits"] >> i & 1)
        assert t["rank"] == (3 if page % 2 == 0 and t["fits"] >> 3 & 1 else least)
        if t["rank"] in one_by_one:
            assert (t["axis"], t["start"], t["len"]) == one_by_one[t["rank"]][page]
    assert any(t["rank"] == 3 and t["fits"] & 7 for t in got.values())
    assert rows(cut.sheared(ink.limit(0), boxes, "page_id")) == rows(cut.sheared(ink, boxes.limit(0), "page_id")) == []


def test_slabs_of_boxes_hold_the_cells_of_the_runs(spark):
    r = random.Random(2)
    boxes = {(p, r.randrange(30), r.randrange(30), r.randrange(1, 12), r.randrange(1, 12)) for p in range(20) for _ in range(r.randrange(1, 6))}
    v = spark.createDataFrame(sorted(boxes), "page_id long, x int, y int, w int, h int")
    cells = lambda got: sorted((p, x, y) for p, y0, y1, x0, x1 in got for y in range(y0, y1 + 1) for x in range(x0, x1 + 1))
    names = ("page_id", "y0", "y1", "x0", "x1")
    want = cells(rows(raster.slabs(raster.runs_of_boxes(v)).select(*names)))
    assert cells(rows(raster.slabs_of_boxes(v).select(*names))) == want == cells(rows(raster.slabs(raster.runs_of_boxes(v), True).select(*names)))


def small_tables(spark, at, pages=60, lines=5):
    """The columns of lineitem, orders, events and embeddings that boxes, taps and points come from."""
    r = random.Random(8)
    tables = {
        "lineitem": ([(p, r.randrange(2000), r.randrange(100), k, float(r.randrange(1, 51))) for p in range(pages) for k in range(1, lines + 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
        "orders": ([(p,) for p in range(pages)], "o_orderkey long"),
        "events": ([(i, i % 7, "2024-01-01 00:00:00", r.choice(["click", "signup"]), r.uniform(0, 500), json.dumps({"k": r.randrange(100)})) for i in range(2 * pages)], "event_id long, user_id long, ts string, event_type string, value double, props string"),
        "embeddings": ([(i, [r.uniform(-0.5, 0.5) for _ in range(64)]) for i in range(9)], "vec_id long, embedding array<float>"),
    }
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return pages * lines


def exchanged(df):
    """(rows, rows written to exchanges) of a query that is run."""
    got, n, todo = rows(df), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Exchange":
            n += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    return got, n


#: Rows that a query may write to exchanges for each box; a box has some seventy lines.
ROWS_A_BOX = {
    "line_gaps": 12,
    "text_lines": 2,
    "nearest_lines": 4,
    "segment_pages": 12,
    "trim_regions": 2,
    "widest_gutters": 2,
    "cut_level1": 2,
    "cut_panels": 10,
    "cut_rects": 4,
    "word_boxes": 8,
    "assemble_reviews": 10,
    "word_boxes_lum": 4,
}


@pytest.mark.parametrize("name", sorted(ROWS_A_BOX))
def test_boxes_are_not_exchanged_line_by_line(spark, tmp_path, monkeypatch, name):
    """Nor does a query write what it goes on from."""
    boxes = small_tables(spark, tmp_path)
    for m in (cut, words):
        monkeypatch.setattr(m, "kept", lambda df: pytest.fail("written"), raising=False)
    got, n = exchanged(queries.QUERIES[name](spark, str(tmp_path)))
    assert got and n <= ROWS_A_BOX[name] * boxes


def test_filters_on_word_boxes_do_not_repeat_how_they_are_worked_out(spark, tmp_path):
    """A plan in which the optimizer puts expressions in the place of names takes all of the driver's memory."""
    small_tables(spark, tmp_path)
    plan = queries.QUERIES["word_boxes"](spark, str(tmp_path)).filter("x IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000


def test_slabs_of_equal_luminance(spark):
    r = random.Random(6)
    cells = [(p, x, y, r.choice([10, 10, 200])) for p in range(4) for x in range(3 * p, 9 + p) for y in range(7) if r.random() < 0.9]
    r.shuffle(cells)
    got = raster.slabs_of_cells(spark.createDataFrame(cells, "page_id long, x int, y int, lum int")).select("page_id", F.inline("slabs")).collect()
    assert sorted((s["page_id"], x, y, s["lum"]) for s in got for x in range(s["x0"], s["x1"] + 1) for y in range(s["y0"], s["y1"] + 1)) == sorted(cells)
    assert len(got) < len(cells) / 1.5


def test_slabs_of_a_crowded_page_come_in_strips(spark, monkeypatch):
    r = random.Random(3)
    boxes = [(1, r.randrange(40), r.randrange(40), r.randrange(1, 9), r.randrange(1, 9)) for _ in range(50)] + [(2, 3, 3, 2, 2), (3, 1, 1, 0, 4), (4, None, 1, 2, 2)]
    v = spark.createDataFrame(boxes, "page_id long, x int, y int, w int, h int")
    want = {(p, i, j) for p, x, y, w, h in boxes[:51] for i in range(x, x + w) for j in range(y, y + h)}
    monkeypatch.setattr(raster, "PART", 200)
    got = [(p, x, y) for p, y0, y1, x0, x1 in rows(raster.slabs_of_boxes(v).select("page_id", *raster.ENDS)) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    assert len(got) == len(want) and set(got) == want


def test_furniture_is_measured_against_all_ink_of_the_page(spark):
    leaves = spark.createDataFrame([(1, "00", 150, 676, 329, 693, 1900), (1, "01", 14, 14, 465, 653, 90_000)], "page_id long, path string, x0 int, y0 int, x1 int, y1 int, ink long")
    maps = spark.createDataFrame([(1, 480, 720, 100_000)], "page_id long, w int, h int, ink long")
    kept = lambda m: [x[1] for x in rows(cut.leaf_filter(leaves, m))]
    assert kept(maps) == ["01"] and kept(maps.withColumn("ink", F.lit(90_000))) == ["00", "01"] and kept(maps.drop("ink")) == ["00", "01"]


def glyphs(y0, y1, *spans, gap=3, width=12):
    """Cells of words that are rows of letter blocks with small gaps."""
    cells = set()
    for a, b in spans:
        x = a
        while x <= b:
            cells |= {(i, y) for i in range(x, min(b, x + width - 1) + 1) for y in range(y0, y1 + 1)}
            x += width + gap
    return cells


def test_word_boxes(spark):
    pages = {
        1: glyphs(80, 120, (100, 228), (300, 450)), 2: glyphs(100, 125, (100, 180), (210, 260), (290, 390)), 3: glyphs(100, 135, (100, 140), (148, 220), gap=1),
        4: {(x, y) for x in range(1000) for y in range(90, 110)}, 5: glyphs(100, 120, (400, 460)) | {(430, y) for y in range(88, 100)}, 6: glyphs(100, 120, (400, 460)) | glyphs(124, 144, (400, 460)),
    }
    taps = [(1, 1, 150, 100), (2, 1, 375, 100), (3, 2, 235, 110), (4, 3, 180, 115), (5, 4, 500, 100), (6, 5, 430, 110), (7, 6, 430, 110), (8, 1, 150, 400), (9, 1, 900, 100), (10, 5, 478, 110), (11, 9, 1, 1)]
    df = spark.createDataFrame([(t, page, float(x), float(y), 1000.0, 1000.0) for t, page, x, y in taps], "tap_id long, page_id long, x double, y double, pw double, ph double")
    got = {r["tap_id"]: r for r in words.word_boxes(df, ink_runs(spark, pages)).collect()}
    assert [got[i]["reason"] for i in range(1, 12)] == [None] * 4 + ["ink runs off the left edge of the crop"] + [None] * 2 + ["no ink near the tap row", "no ink near the tap row", None, "no ink near the tap row"]
    assert abs(got[1]["x"] - 100) <= 2 and 228 <= got[1]["x"] + got[1]["w"] <= 232
    assert got[2]["x"] > 228 and abs(got[3]["x"] - 210) <= 2 and 259 <= got[3]["x"] + got[3]["w"] <= 264
    assert got[4]["x"] >= 140 and got[4]["gap_threshold"] <= 16
    assert got[6]["y"] <= 88 and got[6]["h"] >= 33 and got[7]["h"] < 30 and got[10]["x"] == got[6]["x"]
    assert (got[3]["line_h"], got[3]["median_gap"]) == (52, 6.0) and got[3]["gaps"] == sorted(got[3]["gaps"]) and got[8]["gaps"] is None
    assert rows(words.word_boxes(df.limit(0), ink_runs(spark, pages))) == []


def test_word_boxes_from_luminance(spark):
    """A bubble within dark art keeps its polarity; light words on dark pages and cells that are missing; backgrounds as a loop has them."""
    bubble = {(x, y): 255 if 170 <= x <= 270 and 80 <= y <= 120 else 50 for x in range(40, 381) for y in range(40, 161)}
    word = {(x, y) for x0, x1 in ((190, 219), (223, 230)) for x in range(x0, x1 + 1) for y in range(95, 106)}
    night = {(x, y): 20 for x in range(0, 400) for y in range(20, 180)} | {p: 240 for p in glyphs(95, 105, (150, 210))}
    pages = {1: bubble | dict.fromkeys(word, 0), 2: night, 3: {p: 0 for p in glyphs(95, 105, (190, 230))}}
    cells = spark.createDataFrame([(k, x, y, v) for k, page in pages.items() for (x, y), v in page.items()], "page_id long, x int, y int, lum int")
    taps = [(1, 1, 210.0, 100.0), (2, 2, 180.4, 100.7), (3, 3, 210.0, 100.0), (4, 9, 5.0, 5.0), (5, 2, 10.0, 30.0)]
    df = spark.createDataFrame([(*t, 1000.0, 1000.0) for t in taps], "tap_id long, page_id long, x double, y double, pw double, ph double")
    got = {r["tap_id"]: r for r in words.word_boxes_of_cells(df, cells).collect()}
    assert got[1]["reason"] is None and 165 <= got[1]["x"] and got[1]["x"] + got[1]["w"] <= 275 and got[1]["w"] < 100
    assert got[2]["reason"] is None and abs(got[2]["x"] - 150) <= 2 and abs(got[2]["w"] - 61) <= 3
    # without any paper around it, ink is the background
    assert [got[i]["reason"] for i in (3, 4, 5)] == ["no ink near the tap row"] * 3
    tiled = words.tiles(df)
    c = cells.select(F.col("page_id").alias("of"), F.col("y").alias("ry"), F.col("x").alias("r0"), F.col("x").alias("r1"), "lum")
    told = {r["tap_id"]: (r["background"], r["inverted"]) for r in words.tile_backgrounds(tiled, c).collect()}
    want = {}
    for t in tiled.collect():
        lo, hi = (max(0, t["tx"] - 60), max(0, t["ty"] - 140)), (min(t["tw"] - 1, t["tx"] + 60), min(t["th"] - 1, t["ty"] + 140))
        step = max(1, min(hi[0] - lo[0] + 1, hi[1] - lo[1] + 1) // 32)
        at = ((((x + t["ox"]) // 2, (y + t["oy"]) // 2)) for x in range(lo[0], hi[0] + 1, step) for y in range(lo[1], hi[1] + 1, step))
        seen = sorted(v for p in at if (v := pages.get(t["page_id"], {}).get(p)) is not None)
        if seen:
            bg = next(v for i, v in enumerate(seen) if (i + 1) * 4 >= len(seen) * 3)
            want[t["tap_id"]] = (bg, bg < 128)
    assert told == want and told[1] == (255, False) and told[2] == (20, True)


def test_nearest_flag_and_islands(spark):
    r = random.Random(5)
    for _ in range(3):
        flags = {k: sorted(r.sample(range(60), r.randrange(1, 25))) for k in range(30)}
        origin = {k: r.randrange(60) for k in flags}
        df = spark.createDataFrame([(k, p, p, origin[k], 9, 3, flags[k][0]) for k in flags for p in flags[k]], "k long, x0 int, x1 int, origin int, limit int, blank int, seed int")
        want = []
        for k, f in flags.items():
            near = [p for p in f if abs(p - origin[k]) <= 9]
            want += [(k, min(near, key=lambda p: (abs(p - origin[k]), p)))] if near else []
        assert rows(words.nearest_flag(df, "k")) == sorted(want)
        ends = []
        for k, f in flags.items():
            end = f[0]
            for p in f:
                end = p if p - end - 1 < 3 else end
                if p - end - 1 >= 3:
                    break
            ends.append((k, f[0], end))
        assert rows(words.island_of_seed(df, "k")) == sorted(ends)


def test_reviews_are_assembled(spark):
    taps = spark.createDataFrame([(i, "t", "d", 1, 5.0, 6.0) for i in (1, 2, 3)], "tap_id long, ts string, document string, page long, x double, y double")
    boxes = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0), (2, 1.0, 2.0, 3.0, 4.0), (3, None, None, None, None)], "tap_id long, x double, y double, w double, h double")
    reads = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "a", "b")], "tap_id long, koreader_word string, ocr_word string")
    got = {r["tap_id"]: (r["koreader_word"], r["ocr_word"], r["ocr_failed"], r["box"] is None) for r in reviews.assemble(taps, boxes, reads).collect()}
    assert got == {1: ("a", "b", None, False), 2: (None, None, "no_word", False), 3: (None, None, "no_box", True)}


def test_settings(spark):
    new = spark.createDataFrame([(1, 7, "native", 3.0, None, True)], "id int, performance_profile_version int, detector string, panel_bleed_ratio double, segment_target_width int, debug_timing boolean")
    old = spark.createDataFrame([(1, 2, 1), (2, 3, 300)], "id int, performance_profile_version int, segment_target_width int")
    got = {r["id"]: r for r in settings.clamp_settings(settings.apply_defaults(settings.first_of(new, old, "id"))).collect()}
    assert (got[1]["detector"], got[1]["panel_bleed_ratio"], got[1]["segment_target_width"], got[1]["debug_mode"]) == ("exact", 1.0, 480, True)
    assert (got[2]["detector"], got[2]["segment_target_width"], got[2]["mode"], got[2]["performance_profile_version"]) == ("auto", 480, "manga", 7)


def test_page_images(spark, tmp_path):
    """A grey picture as an uncompressed bitmap: white, with a black block, and a dark frame that the map leaves out."""
    w, h, top = 1000, 40, 54 + 1024
    px = bytearray(b"\xff" * (w * h))
    for y in range(10, 20):
        px[y * w + 100 : y * w + 200] = bytes(100)
    head = struct.pack("<2sIHHI", b"BM", top + w * h, 0, 0, top) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, w * h, 0, 0, 256, 0)
    rows_ = b"".join(bytes(px[y * w : (y + 1) * w]) for y in reversed(range(h)))
    (tmp_path / "p.bmp").write_bytes(head + b"".join(bytes([i, i, i, 0]) for i in range(256)) + rows_)
    (r,) = logs.read_page_images(spark, str(tmp_path)).collect()
    assert (r["native_w"], r["native_h"], r["w"], r["h"], r["background"], r["inverted"]) == (1000, 40, 500, 20, 255, False)
    assert [tuple(x) for x in r["runs"]] == [(y, 50, 99) for y in range(5, 10)]


def test_bitmaps_are_read_as_written(spark, tmp_path):
    """A width that needs padding, all greys, and maps that are left out."""
    r = random.Random(4)
    w, h = 37, 33
    lum = [r.randrange(256) for _ in range(w * h)]
    maps = [(7, w, h, lum), (-3, w, h, [255] * (w * h)), (8, w, h, lum[1:]), (9, w, h, [None] + lum[1:]), (None, w, h, lum), (10, w, h, None), (11, w, h, [256] + lum[1:]), (12, 0, 0, [])]
    logs.write_bitmaps(spark.createDataFrame(maps, "page_id long, w int, h int, lum array<int>"), str(tmp_path / "b"))
    got = {int(x["origin"].split("page_id=")[1].split("/")[0]): x for x in logs.read_page_images(spark, str(tmp_path / "b")).collect()}
    assert sorted(got) == [-3, 7] and got[-3]["runs"] == []
    edge = sorted(v for i, v in enumerate(lum) if i % w in (0, w - 1) or i // w in (0, h - 1))
    bg = edge[(len(edge) - 1) // 2]
    assert (got[7]["w"], got[7]["h"], got[7]["background"]) == (w, h, bg)
    cells = sorted((x, y) for y, x0, x1 in got[7]["runs"] for x in range(x0, x1 + 1))
    assert cells == sorted((i % w, i // w) for i, v in enumerate(lum) if abs(v - bg) > 40)


def test_bitmaps_go_in_parts(spark, tmp_path, monkeypatch):
    small_tables(spark, tmp_path)
    name, real, listed = str(tmp_path), logs.read_page_images, []
    monkeypatch.setattr(logs, "read_page_images", lambda s, path: listed.append(len(list(Path(path.removeprefix("file:")).glob("page_id=*")))) or real(s, path))
    want = rows(queries.QUERIES["page_bitmaps"](spark, name))
    assert want and listed.pop() == 9 and not listed
    monkeypatch.setattr(queries, "FILES_AT_ONCE", 1)
    assert rows(queries.QUERIES["page_bitmaps"](spark, name)) == want
    assert sum(listed) == 9 and max(listed) < 9


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(1, "manga", "auto", False), (2, "comic", "auto", False)], "page_id long, mode string, detector string, border_split boolean")
    for df in (v, v.filter("mode = 'comic'").withColumn("page_id", F.lit(9).cast("long"))):
        logs.write_panels(df, str(tmp_path / "p"))
    assert sorted((r["page_id"], r["mode"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "manga"), (9, "comic")]
    for _ in range(2):
        logs.write_reviews(spark.createDataFrame([("correct",)], "verdict string"), str(tmp_path / "r"))
    assert logs.read_review_log(spark, str(tmp_path / "r"))[0].count() == 2


def test_tile_round_trip(spark):
    b = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0)], "x double, y double, w double, h double")
    tile = geometry.native_to_tile(geometry.box(), 2.0, F.lit(7), F.lit(9))
    back = geometry.tile_to_native(tile, 2.0, F.lit(7), F.lit(9))
    assert rows(b.select(*back)) == [(10.0, 20.0, 30.0, 40.0)]


def test_choose_read(spark):
    df = spark.createDataFrame([("|_-", "shift"), ("my", "x"), (None, " "), ("a|||", "don't")], "a string, b string")
    assert [r[0] for r in df.select(text.choose_read(F.col("a"), F.col("b"))).collect()] == ["shift", "my", None, "don't"]


def test_grid_page_has_six_panels(spark):
    boxes = [(1, 14 + 233 * c, 15 + 235 * r, 219, 220) for c in range(2) for r in range(3)]
    v = spark.createDataFrame(boxes, "page_id long, x int, y int, w int, h int")
    m = spark.createDataFrame([(1, 480, 720)], "page_id long, w int, h int")
    found = cut.to_panels(cut.leaf_filter(cut.xy_cut(raster.runs_of_boxes(v), m), m), m)
    assert [(x, y) for _, x, y, _, _ in rows(found)] == sorted((x - 1, y - 1) for _, x, y, _, _ in boxes)
    manga = sorted(panels.reading_order(found, True).collect(), key=lambda r: r["panel_idx"])
    assert [(r["x"] > 100, r["row_idx"]) for r in manga] == [(True, 1), (False, 1), (True, 2), (False, 2), (True, 3), (False, 3)]


def test_panels_in_native_units(spark):
    leaves = spark.createDataFrame([(1, "00", 0, 10, 99, 49), (1, "01", 120, 60, 198, 98)], "page_id long, path string, x0 int, y0 int, x1 int, y1 int")
    m = spark.createDataFrame([(1, 200, 100, 401, 200)], "page_id long, w int, h int, native_w int, native_h int")
    want = [(1, 0, 18, 202, 84), (1, 238, 118, 162, 82)]
    assert sorted(rows(cut.to_panels(leaves, m, scale_x=2, scale_y=2))) == want
    assert sorted(rows(cut.to_panels(leaves, m.drop("native_w", "native_h"), scale_x=F.lit(2), scale_y=2))) == want
    assert sorted(rows(cut.to_panels(leaves, m.drop("native_w", "native_h")))) == [(1, 0, 9, 101, 42), (1, 119, 59, 81, 41)]


def test_reading_order_rows_are_the_closure(spark):
    pages = [(p, R.randrange(300), R.randrange(300), R.randrange(5, 90), R.randrange(5, 90)) for p in range(60) for _ in range(R.randrange(1, 8))]
    got = panels.reading_order(spark.createDataFrame(list(set(pages)), "page_id long, x int, y int, w int, h int"), False).collect()
    for p in range(60):
        mine = [r for r in got if r["page_id"] == p]
        near = lambda a, b: 10 * abs(2 * a["y"] + a["h"] - 2 * b["y"] - b["h"]) <= 9 * max(a["h"], b["h"])
        group = {id(r): i for i, r in enumerate(mine)}
        for _ in mine:
            for a in mine:
                for b in mine:
                    if near(a, b):
                        group[id(a)] = group[id(b)] = min(group[id(a)], group[id(b)])
        for a in mine:
            for b in mine:
                assert (group[id(a)] == group[id(b)]) == (a["row_idx"] == b["row_idx"])


def test_page_and_screen_round_trip(spark):
    views = spark.createDataFrame([(r, 150.0, 250.0, 50.0, 40.0) for r in (0, 90, 180, 270)], "rot int, x double, y double, w double, h double")
    crop = tuple(map(F.lit, (100.0, 200.0, 300.0, 400.0)))
    bw, bh = F.when(F.col("rot") % 180 == 0, 600.0).otherwise(800.0), F.when(F.col("rot") % 180 == 0, 800.0).otherwise(600.0)
    at = views.select("rot", *[c.alias(n) for n, c in zip(("sx", "sy", "sw", "sh"), geometry.page_to_screen(geometry.box(), crop, bw, bh, F.lit(7.0), F.lit(9.0), F.col("rot")))])
    mid = geometry.screen_to_page(F.col("sx") + F.col("sw") / 2, F.col("sy") + F.col("sh") / 2, crop, bw, bh, F.lit(7.0), F.lit(9.0), F.col("rot"))
    for x, y in rows(at.select(*mid)):
        assert abs(x - 175) <= 3 and abs(y - 270) <= 3


@pytest.mark.parametrize("raw, word, plausible", [("shift\n", "shift", True), ("  my\t\nshift  ", "my shift", False), ("\n \t", None, False), (None, None, False), ("don't", "don't", True), ("dinner?", "dinner?", True), ("año", "año", True), ("ここ", "ここ", True), ("|_-", "|_-", False), ("»«", "»«", False)])
def test_words(spark, raw, word, plausible):
    df = spark.createDataFrame([(raw,)], "raw string").select(text.normalize_word(F.col("raw")).alias("w"))
    assert rows(df.select("w", text.is_plausible(F.col("w")))) == [(word, plausible)]


def test_plausible_bytes(spark):
    """Against a loop over random bytes: cut off, broken off and stray sequences."""

    def brute(b):
        if any(c in b" \t\n\v\f\r" for c in b):
            return False
        letters, junk, i = 0, 0, 0
        while i < len(b):
            n = 1 if b[i] < 0x80 else 4 if b[i] >= 0xF0 else 3 if b[i] >= 0xE0 else 2 if b[i] >= 0xC0 else 0
            if not n:
                i, junk = i + 1, junk + 1
                continue
            if i + n > len(b):
                junk += 1
                break
            good = next((k for k in range(1, n) if not 0x80 <= b[i + k] <= 0xBF), n)
            junk, code = junk + (good < n), b[i : i + good].decode("utf-8", "replace") if good == n else ""
            i += good
            if code and code < "\x80":
                letters, junk = letters + code.isalpha(), junk + (not code.isalnum() and code not in "'-.,!?")
            elif code:
                c = ord(code)
                ok = c >= 0xC0 and c not in (0xD7, 0xF7) and not any(a <= c <= z for a, z in ((0x2000, 0x206F), (0x2190, 0x2BFF), (0x3000, 0x303F)))
                letters, junk = letters + ok, junk + (not ok)
        return letters > 0 and junk <= letters

    r = random.Random(12)
    parts = [b"a", b"Z", b"7", b"-", b"|", "é".encode(), "«".encode(), "ここ".encode(), "→".encode(), "😀".encode(), b"\x80", b"\xc3", b"\xe3\x81", b"\xf0\x9f", b" "]
    words_ = [b"".join(r.choices(parts, [8, 8, 2, 2, 3, 4, 2, 3, 2, 2, 1, 1, 1, 1, 0.3], k=r.randrange(0, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words_)] + [(len(words_), None)], "i int, w binary")
    got = {x["i"]: x["p"] for x in df.select("i", text.is_plausible_bytes(F.col("w")).alias("p")).collect()}
    assert [got[i] for i in range(len(words_))] == [brute(w) for w in words_] and got[len(words_)] is False and {*got.values()} == {True, False}


def test_gap_threshold(spark):
    df = spark.createDataFrame([([3, 3, 20], 40), ([5], 10), ([], 1), ([100, 100], 10)], "gaps array<int>, h int")
    assert [r[0] for r in df.select(reviews.gap_threshold(F.col("gaps"), F.col("h")).cast("int")).collect()] == [6, 5, 2, 15]


def test_classes(spark):
    def row(verdict="incorrect", failed=None, box=(0, 0, 10, 10), user=(0, 0, 10, 10)):
        s = lambda b: b and dict(zip("xywh", map(float, b)))
        return (verdict, failed, s(box), s(user))

    data = [row("correct"), row(failed="no_box"), row(failed="no_word"), row(box=None), row(user=(20, 0, 10, 10)), row(box=(0, 0, 20, 10)), row(box=(6, 0, 10, 10)), row(), row(user=(0, 0, 0, 0))]
    df = spark.createDataFrame(data, "verdict string, ocr_failed string, box struct<x:double,y:double,w:double,h:double>, user_box struct<x:double,y:double,w:double,h:double>")
    got = reviews.classify(df)
    assert [r["classification"] for r in got.collect()] == ["correct", "total_miss_no_box", "total_miss_no_word", "unclassified", "box_bug", "box_bug", "box_bug", "engine_miss", "box_bug"]
    assert [r["n"] for r in reviews.summary(got).collect()] == [1, 1, 4, 1, 1, 1, 9]


def test_throttle_and_positions(spark):
    ev = [(u, float(R.randrange(50)) / 10, i, R.choice([-1, 1])) for i, u in enumerate([1, 2, 3] * 30)]
    df = spark.createDataFrame(ev, "user_id long, ts double, event_id long, d int")
    for u, n in rows(nav.throttle(df)):
        last, k = -1e18, 0
        for _, ts, _, _ in sorted(e for e in ev if e[0] == u):
            if ts - last >= 0.4:
                last, k = ts, k + 1
        assert n == k
    for u, at in rows(nav.final_positions(df, 3)):
        p = 1
        for *_, d in sorted(e for e in ev if e[0] == u):
            p = max(1, min(3, p + d))
        assert at == p


def test_no_row_holds_a_user_history(spark, monkeypatch):
    ev = [(u, float(R.randrange(4000)) / 10, i, R.choice([-2, -1, 1, 2, None])) for i, u in enumerate([7] * 3000 + [1, 2, None] * 20)]
    df = spark.createDataFrame(ev, "user_id long, ts double, event_id long, d int")
    widest, real = [], F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: widest.append(c) or real(c))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept, at = dict(nav.throttle(df).collect()), dict(nav.final_positions(df, 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert not any("event_id" in str(c) for c in widest)
    for u in (7, 1, 2, None):
        last, k, p = -1e18, 0, 1
        for _, ts, _, d in sorted((e for e in ev if e[0] == u), key=lambda e: e[1:3]):
            last, k = (ts, k + 1) if ts - last >= 0.4 else (last, k)
            p = 1 if d is None else max(1, min(5, p + d))
        assert (kept[u], at[u]) == (k, p)
    assert len(kept) == len(at) == 4


@pytest.fixture
def small_parts(spark):
    """Many ranges and small batches, as a large table has them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("n", [0, 1, 4, 300])
def test_running_values_and_neighbours_over_ranges(spark, small_parts, n):
    r = random.Random(n)
    data = [(r.choice(["a", None, *["hot"] * 5, "x", "y"]), r.choice(["p", None]), r.choice([None, 0, 1, 2]), i, r.randint(-3, 3)) for i in range(n)]
    laid = ordered.laid(spark.createDataFrame(data, "u string, w string, t int, i int, v long"), ["u", "w"], ["t", "i"])
    got = ordered.running(ordered.numbered(laid, ["u", "w"], "no"), ["u", "w"], ["v"], ordered.SUM, ["sum"])
    got = ordered.neighbours(got, ["u", "w"], {"pi": "i", "pt": "t"}, {"ni": "i"}).select("i", "no", "sum", "pi", "pt", "ni").collect()
    want, groups = [], {}
    for x in data:
        groups.setdefault(x[:2], []).append(x)
    for xs in groups.values():
        xs.sort(key=lambda x: (x[2] is not None, x[2] or 0, x[3]))
        for j, x in enumerate(xs):
            before, after = xs[j - 1] if j else (None,) * 5, xs[j + 1] if j + 1 < len(xs) else (None,) * 5
            want.append((x[3], j, sum(y[4] for y in xs[: j + 1]), before[3], before[2], after[3]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_user_with_most_events_is_in_many_tasks(spark, small_parts):
    """Positions, accepted steps, views, sessions and verdicts of each event, against loops; one user has two thirds of all events."""
    r = random.Random(6)
    ev = [(u, r.choice([None, *[r.randrange(900) / 10] * 9]), i, r.choice([-2, -1, 1, 2, None])) for i, u in enumerate([7] * 500 + [1, 2, None] * 70)]
    df = spark.createDataFrame(ev, "user_id long, ts double, event_id long, d int").repartition(3)
    parts = {row["part_"] for row in ordered.laid(df, ["user_id"], ["ts", "event_id"]).filter("user_id = 7").select("part_").collect()}
    assert len(parts) >= 5
    spans = ordered.laid(df, ["user_id"], ["ts", "event_id"]).groupBy("part_").count().collect()
    assert max(x["count"] for x in spans) < 300
    at = {x["event_id"]: x["position"] for x in nav.positions(df, 5).collect()}
    took = {x["event_id"]: x["accepted"] for x in nav.accepted_steps(df).collect()}
    count, final = dict(nav.throttle(df).collect()), dict(nav.final_positions(df, 5).collect())
    seen = {x["event_id"] for x in nav.idle_views(df.filter("ts IS NOT NULL"), 0.25).collect()}
    assert len(at) == len(took) == len(ev)
    for u in (7, 1, 2, None):
        own = sorted((e for e in ev if e[0] == u), key=lambda e: (e[1] is not None, e[1] or 0, e[2]))
        last, k, p = -1e18, 0, 1
        for _, ts, i, d in own:
            accepted = ts is not None and ts - last >= 0.4
            last, k = (ts, k + 1) if accepted else (last, k)
            p = 1 if d is None else max(1, min(5, p + d))
            assert (took[i], at[i]) == (accepted, p)
        assert (count[u], final[u]) == (k, p)
        timed = [e for e in own if e[1] is not None]
        assert {e[2] for e in timed} & seen == {e[2] for e, f in zip(timed, [*timed[1:], None], strict=True) if f is None or f[1] - e[1] >= 0.25}


def test_sessions_of_a_hot_user_equal_a_loop(spark, small_parts):
    r = random.Random(2)
    ev = [(u, r.randrange(3000), i) for i, u in enumerate([7] * 300 + [1, 2] * 40 + [3, None, None])]
    got = rows(nav.sessions(spark.createDataFrame(ev, "user_id long, ts long, event_id long"), 20).fillna(-1, ["user_id"]))
    want = []
    for u in (7, 1, 2, 3, None):
        ts = sorted(e[1] for e in ev if e[0] == u)
        gaps = sorted(b - a for a, b in zip(ts, ts[1:], strict=False))
        mid = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2 if gaps else 0
        t = max(2, min(max(3, int(mid * 1.6)), 30) if len(gaps) >= 2 else 10)
        runs = [[ts[0]]]
        for a, b in zip(ts, ts[1:], strict=False):
            if b - a >= t:
                runs.append([])
            runs[-1].append(b)
        want += [(-1 if u is None else u, k, run[0], run[-1], len(run)) for k, run in enumerate(runs)]
    assert got == sorted(want)


def test_throttle_tables_compose(spark, small_parts):
    """Many steps within one hold, equal times, and a hold that no part is as long as."""
    r = random.Random(9)
    for hold in (0.0, 0.3, 7.0, 1e6):
        ev = [(1, r.choice([0.1, 0.2, 0.3]) * r.randrange(60), i) for i in range(220)]
        df = spark.createDataFrame(ev, "user_id long, ts double, event_id long")
        last, k = -1e18, 0
        for _, ts, _ in sorted(ev, key=lambda e: e[1:]):
            last, k = (last, k) if ts - last < hold else (ts, k + 1)
        assert rows(nav.throttle(df, hold)) == [(1, k)]
        assert nav.accepted_steps(df, hold).filter("accepted").count() == k


def test_panel_sequence_over_ranges(spark, small_parts):
    stops = [("d" if i < 60 else None, i, j) for i in range(80) for j in range(1, 1 + i % 4)]
    pages = spark.createDataFrame([("d" if i < 60 else None, i) for i in range(80)], "doc string, page_id long")
    got = panels.panel_sequence(pages, spark.createDataFrame([s[1:] for s in stops], "page_id long, panel_idx int")).collect()
    full = sorted([*((i, j) for _, i, j in stops), *((i, None) for i in range(0, 80, 4))], key=lambda s: (s[0], s[1] or 0))
    for xs in (full[: [i for i, _ in full].index(60)], full[[i for i, _ in full].index(60) :]):
        for a, s, b in zip([(None, None), *xs], xs, [*xs[1:], (None, None)], strict=False):
            assert [(*x[3:5], *x[5:7]) for x in got if tuple(x[1:3]) == s] == [(*b, *a)]


def test_logs(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"verdict": "correct", "document": "a\\/b", "tap": {"x": 1, "y": 2}}\n\n{broken\n')
    good, bad = logs.read_review_log(spark, str(tmp_path / "r.jsonl"))
    assert [(r["document"], r["tap"]["x"], r["box"]) for r in good.collect()] == [("a/b", 1.0, None)] and rows(bad) == [("{broken",)]
    (tmp_path / "t.log").write_text("[tag] page bitmap 74ms (480x720, bg=247, ink=22%)\nnoise\n[tag] memory start free=120MB lua=900KB\n[tag] segmenter rejected: no panels\n")
    t = logs.read_timing_log(spark, str(tmp_path / "t.log"), "[tag]").collect()
    assert (t[0]["name"], t[0]["ms"], t[0]["width"], t[0]["height"], t[0]["background"], t[0]["ink_pct"]) == ("page bitmap", 74, 480, 720, 247, 22)
    assert t[1]["free_mb"] == 120 and t[1]["lua_kb"] == 900 and t[2]["rejected"] == "no panels"
    (tmp_path / "d.log").write_text("[10:11:12] [words] found | a=1, b=2,3, c=x\n")
    assert logs.read_diagnostics_log(spark, str(tmp_path / "d.log")).collect()[0]["fields"] == {"a": "1", "b": "2,3", "c": "x"}


def test_timing_shares(spark, tmp_path):
    lines = ["page bitmap 74ms (480x720)", "page bitmap 70ms (480x720)", "segment 190ms (5 panels, 2 of 3 slanted searches split)", "segment 90ms (5 panels, 0 of 1 slanted searches split, 2 border-line splits)"]
    lines += ["native detect 810ms (6 panels from 29 probes, 1 page render)", "segmenter rejected: only 38% kept", "segmenter rejected: only 9% kept", "memory native detect fallback end free=? lua=900KB", "x" * (1 << 20) + " 5ms"]
    (tmp_path / "t.log").write_text("".join(f"[tag] {m}\n" for m in lines))
    t = logs.read_timing_log(spark, str(tmp_path / "t.log"), "[tag]")
    assert rows(logs.timing_shares(t)) == [(0.5, 0.5)] and rows(logs.rejections(t)) == [("only #% kept", 2)]
    assert rows(t.filter("memory IS NOT NULL").select("memory", "free_mb", "lua_kb")) == [("native detect fallback end", None, 900)]
    assert t.filter("ms = 5").count() == 1
    assert rows(logs.timing_shares(t.limit(0))) == [(None, None)]


def test_stream_reviews_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text("".join(json.dumps({"verdict": R.choice(["correct", "x"]), "ocr_failed": R.choice(["no_box", "no_word", ""])}) + "\n" for _ in range(20)))
    q = streams.stream_reviews(spark, str(src)).select("verdict", "ocr_failed", "classification").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = reviews.classify(spark.read.schema(logs.REVIEW).json(str(src))).select("verdict", "ocr_failed", "classification")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)


def drained(df, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows(df.sparkSession.read.parquet(str(tmp_path / "out")))


def test_matched_verdicts_and_their_stream(spark, tmp_path):
    r = random.Random(8)
    lookups = [(u, r.randrange(3000), i) for i, u in enumerate([1, 2, 3] * 25)]
    verdicts = [(r.choice([1, 2, 3]), r.randrange(3000), r.choice("xyz")) for _ in range(40)]
    want = []
    for u in (1, 2, 3):
        pending = None
        for ts, kind, *rest in sorted([(t, 0, i, "") for w, t, i in lookups if w == u] + [(t, 1, 0, v) for w, t, v in verdicts if w == u]):
            if pending and (late := ts - pending[0] > 120) | (kind == 0):
                want.append((u, pending[1], "abandoned" if late else "superseded", None))
                pending = None
            if kind == 0:
                pending = (ts, rest[0])
            elif pending:
                want.append((u, pending[1], "resolved", rest[1]))
                pending = None
        want += [(u, pending[1], "abandoned", None)] if pending else []
    key = lambda x: x[:3]
    asked, told = spark.createDataFrame(lookups, "user_id long, ts long, lookup_id long"), spark.createDataFrame(verdicts, "user_id long, ts long, verdict string")
    got = sorted(map(tuple, reviews.match_verdicts(asked, told).collect()), key=key)
    assert got == sorted(want, key=key) and {x[2] for x in got} == {"resolved", "superseded", "abandoned"}
    assert rows(reviews.match_verdicts(asked.limit(0), told)) == []

    # two files by time each, rows in any order within one; a row far ahead moves the watermark past all others
    for name, data in (("l", lookups), ("v", verdicts)):
        (tmp_path / name).mkdir()
        for part, keep in enumerate((lambda t: t < 1500, lambda t: t >= 1500)):
            lines = [dict(zip(("user_id", "ts", "lookup_id" if name == "l" else "verdict"), x)) for x in data if keep(x[1])]
            lines += [{"user_id": 9, "ts": 9000, "lookup_id": 1000}] if name == "l" and part else []
            (tmp_path / name / f"{part}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    read = lambda name, extra: spark.readStream.schema(f"user_id long, ts long, {extra}").option("maxFilesPerTrigger", 1).json(str(tmp_path / name)).withColumn("ts", F.timestamp_seconds("ts"))
    out = drained(streams.stream_verdicts(read("l", "lookup_id long"), read("v", "verdict string"), delay="3000 seconds"), tmp_path)
    assert sorted(out, key=key) == got


def test_stream_of_reading_positions(spark, tmp_path):
    r = random.Random(4)
    events = [(u, float(i), i, r.choice(["swipe", "tap", "page_turn", "hold"]), float(r.randrange(480)), r.choice(["west", "east", "north"]), 9.0, r.choice([-1, 0, 2]), r.choice(["manga", "comic"]), r.random() < 0.3, r.random() < 0.2) for i, u in enumerate(r.choices([1, 2], k=80))]
    schema = "user_id long, ts double, event_id long, kind string, x double, direction string, distance double, diff int, mode string, invert boolean, pannable boolean"
    steps = nav.gestures(spark.createDataFrame(events, schema)).filter("action = 'step'").select("user_id", "ts", "event_id", "delta").collect()
    want, at, last = [], {}, {}
    for u, ts, event, d in sorted(tuple(s) for s in steps):
        if ts - last.get(u, -1e18) >= 3:
            at[u], last[u] = max(1, min(4, at.get(u, 1) + int(d))), ts
        want.append((u, event, at[u]))
    (tmp_path / "in").mkdir()
    names = [c.split()[0] for c in schema.split(", ")]
    for part in range(2):
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(names, e))) + "\n" for e in events[part * 40 : part * 40 + 40][::-1]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert drained(streams.stream_reading(stream, 4, 3.0), tmp_path) == sorted(want) and len({x[2] for x in want}) > 2


def test_stream_of_steps_in_any_order(spark, tmp_path):
    """Steps out of order within the delay give what the batch gives; a user who was away for the ttl begins anew."""
    r = random.Random(14)
    steps = [(u, 1 + i * 1.5 + 400 * (i > 60), i, r.choice([-1, 1, 1])) for i, u in enumerate(r.choices([1, 2, 2], k=120))]
    want, state = [], {}
    for u, ts, event, d in steps:
        p, last, seen = state.get(u, (1, -1e18, ts))
        if ts - seen > 300:
            p, last = 1, -1e18
        if ts - last >= 2:
            p, last = max(1, min(5, p + d)), ts
        state[u] = (p, last, ts)
        want.append((u, event, p))
    mixed = sorted(steps, key=lambda s: s[1] + r.uniform(0, 25))
    (tmp_path / "in").mkdir()
    # what comes last takes the watermark past all others, and is itself still held
    for part, own in enumerate((mixed[:40], mixed[40:80], mixed[80:], [(9, 9e5, 999, 1), (1, None, 1000, 1)], [(9, 9.1e5, 1001, 1)])):
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(("user_id", "ts", "event_id", "d"), s))) + "\n" for s in own))
        os.utime(tmp_path / "in" / f"{part}.json", (1e9 + part, 1e9 + part))
    stream = spark.readStream.schema("user_id long, ts double, event_id long, d int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = drained(streams.stream_positions_in_order(stream, 5, 2.0, "60 seconds", 300.0), tmp_path)
    assert [g for g in got if g[0] != 9] == sorted(want) and len({w[2] for w in want}) > 2


def test_state_of_a_user_goes_after_the_ttl():
    """One timer a user; when nothing is left to do, nothing is kept."""

    class State(list):
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value if self.value is not None else iter(list(self))

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None
            self[:] = []

        def put(self, rows):
            self[:] = rows

        appendList = list.extend  # noqa: N815

    class Handle:
        def __init__(self):
            self.timers, self.states = set(), {}

        def getValueState(self, name, _):  # noqa: N802
            return self.states.setdefault(name, State())

        getListState = getValueState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class Time:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    import pandas as pd

    p, handle = streams._InOrder(5, 0.0, 10.0), Handle()
    p.init(handle)
    steps = [(3.0, 3, 1), (1.0, 1, 1), (2.0, 2, 1), (30.0, 4, -1)]
    list(p.handleInputRows((7,), iter([pd.DataFrame({"at": int(t * 1000), "seconds": t, "event_id": i, "d": d} for t, i, d in [s]) for s in steps]), None))
    out = []
    while handle.timers:
        (at,) = handle.timers
        handle.timers.clear()
        out += [tuple(map(int, x)) for part in p.handleExpiredTimer((7,), Time(at), Time(at)) for x in part.itertuples(index=False)]
    assert out == [(7, 1, 2), (7, 2, 3), (7, 3, 4), (7, 4, 1)]
    assert not any(s.exists() or len(s) for s in handle.states.values())


def test_local_background(spark):
    r = random.Random(6)
    lum = {(x, y): r.randrange(256) for x in range(90) for y in range(100)}
    taps = [(1, 1, 45, 50), (2, 1, 3, 2), (3, 1, 88, 97), (4, 2, 5, 5)]
    want = []
    for t, page, tx, ty in taps:
        x0, x1, y0, y1 = max(0, tx - 40), min(89, tx + 40), max(0, ty - 35), min(99, ty + 35)
        step = max(1, min(x1 - x0 + 1, y1 - y0 + 1) // 32)
        seen = sorted(lum[x, y] for x in range(x0, x1 + 1, step) for y in range(y0, y1 + 1, step)) if page == 1 else [255]
        bg = seen[math.ceil(len(seen) * 0.75) - 1]
        want.append((t, bg, bg < 128))
    cells = spark.createDataFrame([(1, x, y, v) for (x, y), v in lum.items()], "page_id long, x int, y int, lum int")
    df = spark.createDataFrame([(*t, 90, 100) for t in taps], "tap_id long, page_id long, tx int, ty int, w int, h int")
    assert rows(raster.local_background(cells, df, 40, 35)) == want


def test_stream_segments_equals_batch(spark, tmp_path):
    v = spark.createDataFrame([(p, 20, 20 + 100 * k, 90, 60) for p in range(3) for k in range(p + 1)], "page_id long, x int, y int, w int, h int")
    runs = raster.runs_of_boxes(v)
    runs.coalesce(1).write.parquet(str(tmp_path / "runs"))
    for _ in range(2):
        streams.stream_segments(spark, str(tmp_path / "runs"), f"file://{tmp_path}/out", str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["page_id"]: r["count"] for r in got.groupBy("page_id").count().collect()} == {0: 1, 1: 2, 2: 3}


def test_a_page_without_panels_is_cut_once_and_a_batch_replaces_its_own(spark, tmp_path, monkeypatch):
    v = spark.createDataFrame([(1, 20, 20, 90, 60), (2, 5, 5, 2, 2)], "page_id long, x int, y int, w int, h int")
    raster.runs_of_boxes(v).coalesce(1).write.parquet(str(tmp_path / "runs"))
    cuts, real = [], streams.cut.xy_cut
    monkeypatch.setattr(streams.cut, "xy_cut", lambda runs, maps: cuts.append(maps.count()) or real(runs, maps))
    run = lambda ck: streams.stream_segments(spark, str(tmp_path / "runs"), f"file://{tmp_path}/out", str(tmp_path / ck)).awaitTermination()
    run("a")
    # a batch whose end was not recorded runs again as the same epoch, and a page that comes anew is not cut again
    run("b")
    raster.runs_of_boxes(v).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    run("b")
    assert cuts == [2, 2] and spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert sorted(r["page_id"] for r in spark.read.parquet(f"{tmp_path}/out-pages").collect()) == [1, 2]


def test_only_rejected_pages_go_to_the_fallback(spark):
    verdicts = spark.createDataFrame([(1, True), (2, False), (3, None)], "page_id long, accepted boolean")
    own = spark.createDataFrame([(1, 5), (2, 6)], "page_id long, x int")
    seen = []

    def other(pages):
        seen.append(sorted(r["page_id"] for r in pages.collect()))
        return pages.select("page_id", F.lit(0).alias("x"))

    assert rows(panels.dispatch("auto", verdicts, own, other)) == [(1, 5), (2, 0), (3, 0)]
    assert rows(panels.dispatch("exact", verdicts, own, other)) == [(1, 0), (2, 0), (3, 0)] and rows(panels.dispatch("fast", verdicts, own, other)) == [(1, 5)]
    assert seen == [[2, 3], [1, 2, 3]]


def test_no_module_but_llm_imports_llm():
    root = Path(__file__).resolve().parents[1] / "pagequire"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
