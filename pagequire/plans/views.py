"""Tables of pages, boxes, rasters, taps and reviews that are derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, x, y, w, h) on pages of 480 x 720, dealt by page before they are made distinct, so that what follows by page needs no other exchange."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id",
        "cast(12 + (l_partkey * 37 + l_linenumber * 101) % 320 AS int) AS x",
        "cast(12 + (l_suppkey * 53 + l_linenumber * 197) % 560 AS int) AS y",
        "cast(34 + 2 * l_quantity AS int) AS w",
        "cast(24 + 2 * l_quantity AS int) AS h",
    ).repartition("page_id").distinct()


BOXES = """SELECT DISTINCT l_orderkey AS page_id, CAST(12 + (l_partkey * 37 + l_linenumber * 101) % 320 AS INTEGER) AS x,
  CAST(12 + (l_suppkey * 53 + l_linenumber * 197) % 560 AS INTEGER) AS y, CAST(34 + 2 * l_quantity AS INTEGER) AS w, CAST(24 + 2 * l_quantity AS INTEGER) AS h FROM lineitem"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, x, y, lum): an 8 x 8 raster of each vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("pos", "e"))
    lum = "cast(least(255, greatest(0, floor((cast(e AS double) + 0.6) * 212))) AS int)"
    return rows.selectExpr("page_id", "cast(pos % 8 AS int) AS x", "cast(pos div 8 AS int) AS y", f"{lum} AS lum")


CELLS = """SELECT vec_id AS page_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y,
  CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.6) * 212))) AS INTEGER) AS lum FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, raw)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "raw"))


WORDS = "SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS pos, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts in seconds, kind, x, y, k)."""
    kind = "CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'swipe' WHEN 'purchase' THEN 'page_turn' WHEN 'signup' THEN 'hold' ELSE 'noop' END AS kind"
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(unix_micros(cast(ts AS timestamp)) / 1000000 AS double) AS ts", kind, "value", "cast(get_json_object(props, '$.k') AS int) AS k")
    return e.selectExpr("event_id", "user_id", "ts", "kind", "value / 500 * 480 AS x", "k / 100 * 720 AS y", "k")


EVENTS = """SELECT event_id, user_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS ts,
  CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'swipe' WHEN 'purchase' THEN 'page_turn' WHEN 'signup' THEN 'hold' ELSE 'noop' END AS kind,
  value / 500 * 480 AS x, CAST(props->>'$.k' AS INTEGER) / 100 * 720 AS y, CAST(props->>'$.k' AS INTEGER) AS k FROM events"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, verdict, ocr_failed, box, user_box, gaps, line_h), distinct."""
    x, y, w, h = "12 + (l_partkey * 37 + l_linenumber * 101) % 320", "12 + (l_suppkey * 53 + l_linenumber * 197) % 560", "34 + 2 * l_quantity", "24 + 2 * l_quantity"
    d = lambda e: f"cast({e} AS double)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id",
        "if(l_returnflag = 'R', 'correct', 'incorrect') AS verdict",
        "CASE l_linenumber % 5 WHEN 0 THEN 'no_box' WHEN 4 THEN 'no_word' END AS ocr_failed",
        f"named_struct('x', {d(x)}, 'y', {d(y)}, 'w', {d(w)}, 'h', {d(h)}) AS box",
        f"if(l_partkey % 11 = 0, NULL, named_struct('x', {d(x)} + l_discount * 200, 'y', {d(y)} + l_tax * 100, 'w', ({w}) * (1 + l_discount), 'h', ({h}) * (1 + l_discount))) AS user_box",
        "transform(sequence(1, cast(l_quantity AS int) % 5 + 1), i -> cast((l_quantity * i * 7) % 31 AS int)) AS gaps",
        "cast(l_quantity AS int) AS line_h",
    ).distinct()


_X, _Y, _W, _H = "12 + (l_partkey * 37 + l_linenumber * 101) % 320", "12 + (l_suppkey * 53 + l_linenumber * 197) % 560", "34 + 2 * l_quantity", "24 + 2 * l_quantity"
REVIEWS = f"""SELECT DISTINCT l_orderkey AS page_id, CASE WHEN l_returnflag = 'R' THEN 'correct' ELSE 'incorrect' END AS verdict,
  CASE l_linenumber % 5 WHEN 0 THEN 'no_box' WHEN 4 THEN 'no_word' END AS ocr_failed,
  CAST({_X} AS DOUBLE) AS bx, CAST({_Y} AS DOUBLE) AS by_, CAST({_W} AS DOUBLE) AS bw, CAST({_H} AS DOUBLE) AS bh, l_partkey % 11 <> 0 AS has,
  CAST({_X} AS DOUBLE) + l_discount * 200 AS ux, CAST({_Y} AS DOUBLE) + l_tax * 100 AS uy, ({_W}) * (1 + l_discount) AS uw, ({_H}) * (1 + l_discount) AS uh,
  list_transform(range(1, CAST(l_quantity AS INTEGER) % 5 + 2), lambda i: CAST((l_quantity * i * 7) % 31 AS INTEGER)) AS gaps, CAST(l_quantity AS INTEGER) AS line_h FROM lineitem"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each customer, with nulls and odd values."""
    n = lambda e, name: f"if(c_custkey % 3 = 0, NULL, {e}) AS {name}"
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS setting_id",
        "cast(c_custkey % 9 AS int) AS performance_profile_version",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'native' WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'MACHINERY' THEN 'fast' WHEN 'HOUSEHOLD' THEN 'odd' END AS detector",
        "CASE c_custkey % 4 WHEN 0 THEN 'comic' WHEN 1 THEN 'manga' WHEN 2 THEN 'webtoon' END AS mode",
        "CASE c_custkey % 6 WHEN 0 THEN 'loose' WHEN 1 THEN 'margin' WHEN 2 THEN 'none' WHEN 3 THEN 'tight' WHEN 4 THEN 'strict' END AS crop_mode",
        "CASE c_custkey % 3 WHEN 0 THEN 'smooth' WHEN 1 THEN 'odd' END AS nav_transition_mode",
        n("c_acctbal / 5000", "panel_bleed_ratio"),
        n("c_acctbal / 10000", "panel_margin_ratio"),
        n("c_acctbal / 300", "panel_bleed_min"),
        n("c_acctbal / 9000", "panel_prefetch_delay"),
        n("c_acctbal / 6000", "nav_transition_duration"),
        n("c_acctbal / 250", "nav_transition_frames"),
        n("0.9", "full_page_panel_ratio"),
        n("0.007", "segment_gutter_ratio"),
        n("cast(c_custkey % 8 AS int)", "panel_grid_cols"),
        n("cast(c_custkey % 20 AS int)", "panel_cache_pages"),
        n("cast(300 + c_custkey % 500 AS int)", "segment_target_width"),
        "CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS debug_mode",
        "CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS debug_timing",
    ).withColumns({"full_page_panel_ratio": F.col("full_page_panel_ratio").cast("double"), "segment_gutter_ratio": F.col("segment_gutter_ratio").cast("double")})


_GIVEN = {
    "panel_bleed_ratio": "c_acctbal / 5000", "panel_margin_ratio": "c_acctbal / 10000", "panel_bleed_min": "c_acctbal / 300", "panel_prefetch_delay": "c_acctbal / 9000", "nav_transition_duration": "c_acctbal / 6000", "nav_transition_frames": "c_acctbal / 250",
    "full_page_panel_ratio": "CAST(0.9 AS DOUBLE)", "segment_gutter_ratio": "CAST(0.007 AS DOUBLE)", "panel_grid_cols": "CAST(c_custkey % 8 AS INTEGER)", "panel_cache_pages": "CAST(c_custkey % 20 AS INTEGER)", "segment_target_width": "CAST(300 + c_custkey % 500 AS INTEGER)",
}
SETTINGS = f"""SELECT c_custkey AS setting_id, CAST(c_custkey % 9 AS INTEGER) AS v,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'native' WHEN 'AUTOMOBILE' THEN 'auto' WHEN 'MACHINERY' THEN 'fast' WHEN 'HOUSEHOLD' THEN 'odd' END AS detector,
  CASE c_custkey % 4 WHEN 0 THEN 'comic' WHEN 1 THEN 'manga' WHEN 2 THEN 'webtoon' END AS mode,
  CASE c_custkey % 6 WHEN 0 THEN 'loose' WHEN 1 THEN 'margin' WHEN 2 THEN 'none' WHEN 3 THEN 'tight' WHEN 4 THEN 'strict' END AS crop_mode,
  CASE c_custkey % 3 WHEN 0 THEN 'smooth' WHEN 1 THEN 'odd' END AS nav_transition_mode,
  {", ".join(f"CASE WHEN c_custkey % 3 <> 0 THEN {e} END AS {k}" for k, e in _GIVEN.items())},
  coalesce(CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END, CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false END, false) AS debug_mode FROM customer"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): a line of a timing log for each event."""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"concat('[tag] ', {LINE}) AS value")


#: A line of each kind by event, in SQL of both engines.
LINE = """CASE event_id % 6 WHEN 0 THEN concat('page bitmap ', cast(50 + event_id % 97 as string), 'ms (480x', cast(600 + event_id % 200 as string), ' bg=', cast(event_id % 256 as string), CASE WHEN event_id % 4 = 0 THEN ' inverted' ELSE '' END, ' ink=', cast(event_id % 100 as string), '%)')
  WHEN 1 THEN concat('segment ', cast(20 + event_id % 181 as string), 'ms (', cast(event_id % 9 as string), ' panels, ', cast(event_id % 3 as string), ' of ', cast(3 + event_id % 2 as string), ' slanted searches split)')
  WHEN 2 THEN concat('native detect ', cast(700 + event_id % 301 as string), 'ms (', cast(event_id % 7 as string), ' panels from 29 probes)')
  WHEN 3 THEN concat('memory page ', cast(event_id as string), ' free=', cast(event_id % 500 as string), 'MB lua=', cast(event_id % 4000 as string), 'KB')
  WHEN 4 THEN concat('segmenter rejected: only ', cast(event_id % 50 as string), '% of the covered area kept') ELSE concat('cache evict ', cast(event_id as string), ':manga:auto') END"""
