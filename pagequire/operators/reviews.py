"""Reviews of word look-ups: what went wrong, how often, and how another gap threshold would have done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import overlap
from .ordered import laid, neighbours

#: The classes in the order of the summary.
CLASSES = ("correct", "engine_miss", "box_bug", "total_miss_no_box", "total_miss_no_word", "unclassified")


def classify(reviews: DataFrame) -> DataFrame:
    """Adds containment, size_ratio, edge_offset and classification to reviews(verdict, ocr_failed, box, user_box)."""
    part = lambda s: tuple(F.col(f"{s}.{c}") for c in ("x", "y", "w", "h"))
    b, u = part("box"), part("user_box")
    both = F.col("box").isNotNull() & F.col("user_box").isNotNull()
    area, user = b[2] * b[3], u[2] * u[3]
    containment = F.when(both, F.coalesce(F.try_divide(overlap(b, u), user), F.lit(0.0)))
    ratio = F.when(both, F.try_divide(area, user))
    offset = F.when(both, F.coalesce(F.try_divide(F.greatest(F.abs(b[0] - u[0]), F.abs(b[0] + b[2] - u[0] - u[2])), b[3]), F.lit(0.0)))
    rows = reviews.withColumn("containment", containment).withColumn("size_ratio", ratio).withColumn("edge_offset", offset)
    return rows.withColumn(
        "classification",
        F.when(F.col("verdict") == "correct", "correct")
        .when(F.col("ocr_failed") == "no_box", "total_miss_no_box")
        .when(F.col("ocr_failed") == "no_word", "total_miss_no_word")
        .when(~both, "unclassified")
        .when((F.col("containment") < 0.3) | (F.col("size_ratio") > 1.3) | (F.col("edge_offset") > 0.5), "box_bug")
        .otherwise("engine_miss"),
    )


def summary(classified: DataFrame) -> DataFrame:
    """(ord, classification, n): all classes in order, 0 where there are none, then the total."""
    n = classified.agg(*[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES], F.count("*").alias("total"))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("classification"), F.col(c).alias("n")) for i, c in enumerate((*CLASSES, "total"))])
    return n.select(F.inline(each))


def assemble(taps: DataFrame, boxes: DataFrame, reads: DataFrame) -> DataFrame:
    """Pending reviews of `taps(tap_id, ts, document, page, x, y)`: with `boxes(tap_id, x, y, w, h)` and `reads(tap_id, koreader_word, ocr_word)`.

    A look-up with a word keeps both words and its box. One without a box failed as no_box, one with a box but no word
    as no_word; neither has words.
    """
    b = boxes.filter("x IS NOT NULL").select("tap_id", F.struct("x", "y", "w", "h").alias("box"))
    full = taps.select("tap_id", "ts", "document", "page", F.struct("x", "y").alias("tap")).join(b, "tap_id", "left").join(reads, "tap_id", "left")
    failed = F.when(F.col("box").isNull(), "no_box").when(F.col("ocr_word").isNull(), "no_word")
    words = [F.when(failed.isNull(), F.col(c)).alias(c) for c in ("koreader_word", "ocr_word")]
    return full.select("tap_id", "ts", "document", "page", "tap", "box", *words, failed.alias("ocr_failed"))


def match_verdicts(lookups: DataFrame, verdicts: DataFrame, within: float = 120.0) -> DataFrame:
    """(user_id, lookup_id, outcome, verdict) for each of `lookups(user_id, ts in seconds, lookup_id)`.

    A user has one look-up pending, the latest. The next of verdicts(user_id, ts, verdict) ends it as resolved, a newer
    look-up as superseded, and after `within` seconds it is abandoned. What comes next thus decides alone; of equal times,
    look-ups go first, by id, then verdicts, by text. Rows without a time or user take no part. Ranges of user and time
    exchange the rows at their ends, so a user may have any number of rows.
    """
    asked = lookups.select("user_id", F.col("ts").cast("double").alias("ts"), F.lit(0).alias("kind"), "lookup_id", F.lit(None).cast("string").alias("verdict"))
    told = verdicts.select("user_id", F.col("ts").cast("double").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast(lookups.schema["lookup_id"].dataType).alias("lookup_id"), F.col("verdict").cast("string").alias("verdict"))
    rows = laid(asked.unionByName(told).filter("user_id IS NOT NULL AND ts IS NOT NULL"), ["user_id"], ["ts", "kind", "lookup_id", "verdict"])
    rows = neighbours(rows, ["user_id"], after={f"next_{c}": c for c in ("ts", "kind", "verdict")}).filter("kind = 0")
    soon = F.coalesce(F.col("next_ts") - F.col("ts") <= within, F.lit(False))
    outcome = F.when(~soon, "abandoned").when(F.col("next_kind") == 0, "superseded").otherwise("resolved")
    return rows.select("user_id", "lookup_id", outcome.alias("outcome"), F.when(soon, F.col("next_verdict")).alias("verdict"))


def report_json(rows: DataFrame) -> DataFrame:
    """(json): each row as an object; numbers that are not finite become null."""
    finite = [F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("json"))


def gap_threshold(gaps: Column, h: Column, multiplier: Column | float = 1.6) -> Column:
    """Where a gap splits words on a line of height h: from the median gap, within bounds that follow the height; a lone gap tells nothing."""
    s = F.array_sort(gaps)
    n = F.size(s)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    multiplier = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    wide = F.least(F.greatest(F.floor(h * 0.15), F.floor(mid * multiplier)), F.ceil(h * 1.5))
    return F.greatest(F.lit(2), F.when(n >= 2, wide).otherwise(F.floor(h * 0.5)))


def sweep(reviews: DataFrame, multipliers: Sequence[float]) -> DataFrame:
    """(multiplier, n_gaps, n_split): how many logged gaps of reviews(gaps, line_h) each multiplier would split."""
    many = reviews.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    cut = many.withColumn("t", gap_threshold(F.col("gaps"), F.col("line_h"), F.col("multiplier")))
    split = F.size(F.filter("gaps", lambda g: g >= F.col("t")))
    return cut.groupBy("multiplier").agg(F.sum(F.size("gaps")).alias("n_gaps"), F.sum(split).alias("n_split"))
