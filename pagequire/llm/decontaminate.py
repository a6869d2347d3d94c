"""Benchmark passages in documents: a prefix-filtered join of shingles, verified on item-sized windows.

A window is `size` consecutive words of an item (the whole item, where it has fewer). A document contains a window only
if it contains every shingle of it, so the shortest prefix in the order of rarity, one shingle, is enough to find all
candidates: each window is filed under its rarest shingle, counted over all documents, with the place it has in the
window. A document shingle that meets a filed one fixes where the window would start; it must fit between the
document's ends, and then every word is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bit_set, cut, in_bit_set, modest_batches
from .words import ALNUM, hashed, shingled



def _log_bits(n: int) -> int:
    """A bit set of about 256 bits for each of n keys, within 4 million and 128 million bits."""
    return min(27, max(22, n.bit_length() + 8))


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """(hashes of the words, the text) for each text."""
    for lo in range(0, len(texts), 128):
        part = texts.slice(lo, 128).to_pylist()
        words, _, counts = hashed(part, ALNUM)
        ends = np.cumsum(counts)
        for text, end, n in zip(part, ends, counts, strict=True):
            yield words[end - n : end], text


def _windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """(item, w, len, words, places): each distinct window of each item with its shingles, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, (words, text) in zip(b.column(0).to_pylist(), _words(b.column(1)), strict=True):
                if not words.size:
                    continue
                whole = text.translate(ALNUM).split()
                n = min(size, len(whole))
                grams = shingled(words, min(shingle, n)).view(np.int64)
                for i in range(len(whole) - n + 1):
                    out.append((item, b" ".join(whole[i : i + n]).decode("utf-8", "replace"), n, grams[i : i + n - min(shingle, n) + 1].tolist()))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.record_batch({"item": pa.array(cols[0], pa.int64()), "words": pa.array(cols[1], pa.string()), "len": pa.array(cols[2], pa.int32()), "grams": pa.array(cols[3], pa.list_(pa.int64()))})

    return items.filter("id IS NOT NULL").select("id", F.col("text").cast("binary")).mapInArrow(run, "item long, words string, len int, grams array<long>")


def _scan(docs: DataFrame, bits: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """(key, row, n_words, gram, at, first, near): each document once, with its number of words and null gram, and each of its shingles that may be in the bit set, with `reach` words on each side.

    key tells documents apart, whatever `row` is; it is fixed once the result is checkpointed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ("key", "row", "n_words", "gram", "at", "first", "near")
    kinds = (pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []

            def flush(rows: pa.Array = b.column(0)) -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                arrays = [rows.take(pa.array(c, pa.int32())) if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for row, (words, text) in enumerate(_words(b.column(1))):
                key += 1
                out.append((key, row, words.size, None, None, None, None))
                whole = None
                for k in widths:
                    if words.size < k:
                        continue
                    grams = shingled(words, k)
                    for i in np.flatnonzero(in_bit_set(shared.value, grams)):
                        whole = whole or text.translate(ALNUM).split()
                        lo = max(0, int(i) - reach)
                        out.append((key, row, None, int(grams[i : i + 1].view(np.int64)[0]), int(i), lo, b" ".join(whole[lo : int(i) + reach]).decode("utf-8", "replace")))
                        if len(out) >= 10_000:
                            yield flush()
            yield flush()

    kind = T.StructType([T.StructField("key", T.LongType()), T.StructField("row", docs.schema["row"].dataType), *T.StructType.fromDDL("n_words long, gram long, at int, first int, near string")])
    return docs.select("row", F.col("text").cast("binary")).mapInArrow(run, kind)


def _counted(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(gram, n): how often shingles that may be in the bit set stand in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [g[in_bit_set(shared.value, g)] for words, _ in _words(b.column(0)) for k in widths if words.size >= k for g in (shingled(words, k),)]
            values, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.record_batch({"gram": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())})

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, items: DataFrame, size: int = 13, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """((key, row, n_words) for each document, (key, start, len, item) for each place where a window of an item stands).

    docs(row, text), items(id, text). Null and empty texts have no words; a null item id takes no part. key tells
    documents apart where rows are null or repeated.
    """
    modest_batches(docs.sparkSession)
    windows = cut(_windows(items, size, shingle))
    grams = windows.select(F.explode("grams").alias("gram")).distinct()
    bits = bit_set(grams, F.col("gram"), _log_bits(grams.count()))
    widths = sorted({min(shingle, r["len"]) for r in windows.select("len").distinct().collect()})
    counts = _counted(docs, bits, widths)
    each = windows.groupBy("words", "len").agg(F.first("grams").alias("grams"))
    placed = each.select("words", "len", F.posexplode("grams").alias("place", "gram")).join(counts, "gram")  # a window with a shingle that no document has is in none
    have = F.row_number().over(Window.partitionBy("words").orderBy("n", "gram", "place"))
    complete = F.count("*").over(Window.partitionBy("words")) == F.col("len") - F.least(F.col("len"), F.lit(shingle)) + 1
    filed = cut(placed.withColumn("r", have).withColumn("all", complete).filter("r = 1 AND all").select("gram", "place", "words", "len"))

    rows = cut(_scan(docs, bit_set(filed.select("gram"), F.col("gram"), _log_bits(filed.count())), widths, size))
    met = rows.filter("gram IS NOT NULL").join(filed, "gram").withColumn("start", F.col("at") - F.col("place"))
    # `near` ends with the text, so a window that goes on beyond it finds too few words
    fits = met.filter("start >= 0 AND array_join(slice(split(near, ' '), greatest(1, start - first + 1), len), ' ') = words")
    found = fits.select("key", "start", "len", "words").join(windows.select("words", "item").distinct(), "words").select("key", "start", "len", "item")
    return rows.filter("gram IS NULL").select("key", "row", "n_words"), found


def judge(docs: DataFrame, items: DataFrame, size: int = 13, num: int = 1, den: int = 20) -> DataFrame:
    """(row, n_words, n_hit, n_items, items, contaminated) for each row of `docs(row, text)`, null and repeated rows too.

    n_hit: words inside any occurrence; items: sorted ids, as text, of the items with occurrences; contaminated: some
    word is hit and at least num / den of all are. Empty and null texts have 0 words and are clean; without items all are.
    """
    counts, found = occurrences(docs, items, size)
    found = cut(found)
    spans = found.select("key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("key", F.col("item").cast("string").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    full = counts.join(hit.join(named, "key"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return full.select("row", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (den * n_hit >= num * F.col("n_words"))).alias("contaminated"))
