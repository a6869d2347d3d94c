"""Logs and page images as tables, and results back to files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOX = "struct<x:double,y:double,w:double,h:double>"
REVIEW = (
    f"ts string, document string, page long, tap struct<x:double,y:double>, box {_BOX}, native struct<w:double,h:double>, koreader_word string, ocr_word string, ocr_failed string, "
    f"diagnostics struct<gap_threshold:double,median_gap:double,line_h:double,gaps:array<double>,zoom:double,multiplier:double>, verdict string, user_box {_BOX}, image string, correct_text string"
)


def review_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, bad lines) of `lines(value)`: JSON by a fixed schema; blank lines are skipped, absent keys are null, broken lines come back as text."""
    schema = T.StructType([*T.StructType.fromDDL(REVIEW).fields, T.StructField("_bad", T.StringType())])
    rows = lines.filter("trim(value) <> ''").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.filter("r._bad IS NULL").select("r.*").drop("_bad"), rows.filter("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def read_review_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The reviews, and the broken lines, of log files."""
    return review_lines(spark.read.text(path))


def write_reviews(df: DataFrame, path: str) -> None:
    """Append one JSON object for each row."""
    df.write.mode("append").json(path)


def write_panels(df: DataFrame, path: str) -> None:
    """Panel lists by mode, detector and border_split; partitions that are written again are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "detector", "border_split").parquet(path)


def timing_lines(lines: DataFrame, tag: str, *keep: str) -> DataFrame:
    """(name, ms, detail, width, height, background, inverted, ink_pct, border_pct, panels, free_mb, lua_kb, rejected, evicted, splits, searches, memory) of `lines(value)` that begin with the tag.

    splits of searches slanted ones split; memory: the label of a memory line, whose free_mb may be unknown. keep: other
    columns of the lines that stay.
    """
    line = lines.filter(F.col("value").startswith(tag + " ")).select(*keep, F.expr(f"substring(value, {len(tag) + 2})").alias("m"))
    take = lambda p, t: F.expr(f"try_cast(nullif(regexp_extract(m, r'{p}', 1), '') AS {t})")
    return line.select(
        *keep, take(r"^(.*?) \d+ms", "string").alias("name"), take(r" (\d+)ms", "int").alias("ms"), take(r"\((.*)\)\s*$", "string").alias("detail"),
        take(r"(\d+)x\d+", "int").alias("width"), take(r"\d+x(\d+)", "int").alias("height"), take(r"bg=(\d+)", "int").alias("background"), F.col("m").contains("inverted").alias("inverted"),
        take(r"ink=(\d+)%", "int").alias("ink_pct"), take(r"border=(\d+)%", "int").alias("border_pct"), take(r"(\d+) panels?", "int").alias("panels"),
        take(r"free=(\d+)MB", "int").alias("free_mb"), take(r"lua=(\d+)KB", "int").alias("lua_kb"), take(r"segmenter rejected: (.*)$", "string").alias("rejected"), take(r"cache evict (.*)$", "string").alias("evicted"),
        take(r"(\d+) of \d+ slanted searches", "int").alias("splits"), take(r"\d+ of (\d+) slanted searches", "int").alias("searches"), take(r"^memory (.*) free=", "string").alias("memory"),
    )


def read_timing_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The timing lines of log files; tag: what the program that wrote them puts before each."""
    return timing_lines(spark.read.text(path), tag)


def timing_summary(lines: DataFrame) -> DataFrame:
    """(name, n, p50, p95) of each span."""
    return lines.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"), F.percentile_approx("ms", 0.5).alias("p50"), F.percentile_approx("ms", 0.95).alias("p95"))


def timing_shares(lines: DataFrame) -> DataFrame:
    """(fallback, split), one row: native detections for each page bitmap, and the share of slanted searches that split; null if there are none to count."""
    count = lambda name: F.count_if(F.coalesce(F.col("name") == name, F.lit(False)))
    share = lambda a, b: F.when(b > 0, a / b)
    return lines.agg(share(count("native detect"), count("page bitmap")).alias("fallback"), share(F.sum("splits"), F.sum("searches")).alias("split"))


def rejections(lines: DataFrame) -> DataFrame:
    """(reason, n): how often the segmenter gave each reason, whatever the figures in it (written as #)."""
    return lines.filter("rejected IS NOT NULL").groupBy(F.regexp_replace("rejected", r"\d+", "#").alias("reason")).agg(F.count("*").alias("n"))


def diagnostics_lines(lines: DataFrame) -> DataFrame:
    """(time, tag, message, fields) of `lines(value)` that read `[HH:MM:SS] [tag] message | k=v, k=v`; values may hold commas."""
    at = lines.select(*[F.regexp_extract("value", r"^\[(\d\d:\d\d:\d\d)\] \[([^\]]*)\] (.*?)(?: \| (.*))?$", i).alias(n) for i, n in enumerate(("time", "tag", "message", "kv"), 1)])
    return at.filter("time <> ''").select("time", "tag", "message", F.expr(r"if(kv = '', map(), str_to_map(kv, ', (?=\\w+=)', '='))").alias("fields"))


def read_diagnostics_log(spark: SparkSession, path: str) -> DataFrame:
    """The diagnostics lines of log files."""
    return diagnostics_lines(spark.read.text(path))


def read_page_images(spark: SparkSession, path: str, target_width: int = 480, delta: int = 40) -> DataFrame:
    """(origin, native_w, native_h, w, h, background, inverted, runs): ink runs of page images, at about target_width cells a line.

    Colour becomes grey by the BT.601 weights. The background is the lower median of the whole picture's outer ring. Maps with a side
    under 16, or pages with one under 32, are left out. runs: (y, x0, x1), both ends included.
    """
    schema = "origin string, native_w int, native_h int, w int, h int, background int, inverted boolean, runs array<struct<y:int,x0:int,x1:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, height, width, channels, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
                grey = np.floor(px[..., :3] @ [0.114, 0.587, 0.299] + 0.5).astype(int) if channels >= 3 else px[..., 0].astype(int)
                step = max(1, width // target_width)
                m = grey[::step, ::step][: height // step, : width // step]
                if min(width, height) < 32 or min(m.shape) < 16:
                    continue
                ring = max(1, int(min(width, height) * 0.01))
                edge = np.ones(grey.shape, bool)
                edge[ring:-ring, ring:-ring] = False
                values = np.sort(grey[edge])
                bg = int(values[(values.size - 1) // 2])
                ink = np.pad(np.abs(m - bg) > delta, ((0, 0), (1, 1)))
                change = np.diff(ink.astype(np.int8), axis=1)
                (y, x0), (_, x1) = np.nonzero(change == 1), np.nonzero(change == -1)
                out.append({"origin": origin, "native_w": width, "native_h": height, "w": m.shape[1], "h": m.shape[0], "background": bg, "inverted": bg < 128, "runs": [{"y": int(a), "x0": int(p), "x1": int(q) - 1} for a, p, q in zip(y, x0, x1, strict=True)]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("origin", pa.string()), *[(c, pa.int32()) for c in ("native_w", "native_h", "w", "h", "background")], ("inverted", pa.bool_()), ("runs", pa.list_(pa.struct([(c, pa.int32()) for c in ("y", "x0", "x1")])))]))

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return images.mapInArrow(run, schema)


def bitmap(w: str, h: str, lum: str) -> Column:
    """An uncompressed bitmap file of 256 greys, as bytes, from columns w, h and lum: h lines of w values in 0..255, the top one first."""
    word = lambda n: "concat(" + ", ".join(f"substr(lpad(hex({n}), 8, '0'), {i}, 2)" for i in (7, 5, 3, 1)) + ")"
    pad = f"pmod(-{w}, 4)"
    size, top = f"({w} + {pad}) * {h}", 54 + 4 * 256
    greys = "".join(f"{i:02X}" * 3 + "00" for i in range(256))
    head = ["'424D'", word(f"{top} + {size}"), "'00000000'", word(top), word(40), word(w), word(h), "'01000800'", word(0), word(size), word(0), word(0), word(256), word(0), f"'{greys}'"]
    line = f"concat(array_join(transform(slice({lum}, y * {w} + 1, {w}), v -> lpad(hex(v), 2, '0')), ''), repeat('00', {pad}))"
    return F.expr(f"unhex(concat({', '.join(head)}, array_join(transform(sequence({h} - 1, 0, -1), y -> {line}), '')))")


def write_bitmaps(maps: DataFrame, path: str) -> None:
    """One bitmap file of each of maps(page_id, w, h, lum), in a folder page_id=... of path, through Spark's own writer.

    Maps with a null or without values are left out. Each file has a line break after the picture, which no reader minds.
    """
    whole = maps.filter("page_id IS NOT NULL AND w > 0 AND h > 0 AND size(lum) = w * h AND NOT exists(lum, v -> v IS NULL OR v NOT BETWEEN 0 AND 255)")
    whole.select("page_id", bitmap("w", "h", "lum").cast("string").alias("value")).write.mode("overwrite").partitionBy("page_id").text(path)
