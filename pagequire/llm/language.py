"""Language identification with a bit-sliced Bloom filter over byte n-grams.

Every n-gram has k positions in one table of bit masks; bit l of a mask belongs to language l. The AND of an n-gram's
masks names all languages whose filters hold it, so one look-up asks every language at once. A text's hits are counted
by language, each count is corrected for the false positives that the filter's load predicts, and the largest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, modest_batches
from .words import mix

_U = np.uint64
#: ASCII bytes that are no letters separate n-grams' words; bytes beyond ASCII stay.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SIZES = (3, 5)
PART = 1 << 19
#: Languages in one mask.
BITS = 63


@dataclass(frozen=True)
class Filters:
    """masks: for each 63 languages a row, position -> bits of languages; load: by language, the share of positions set."""

    languages: tuple[str, ...]
    masks: np.ndarray
    load: np.ndarray
    hashes: int
    prior: int


def _clean(text: str | None) -> tuple[bytes, bool]:
    """Words of lower-case letters between single spaces; whether the text has a letter."""
    if not text:
        return b"", False
    low = text.lower()
    body = b" ".join(low.encode("utf-8", "replace").translate(_LETTERS).split())
    return body, any(map(str.isalpha, low)) if body else False


def _grams(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all n-grams and the part each is in; no n-gram spans two parts."""
    buf = np.frombuffer(b"\0" + b"\0".join(b" " + p + b" " for p in parts) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 3 for p in parts])
    for n in SIZES:
        if buf.size < n:
            continue
        m = buf.size - n + 1
        code = np.full(m, n, np.uint64)
        whole = np.ones(m, bool)
        for j in range(n):
            b = buf[j : j + m]
            code = (code << _U(8)) | b
            whole &= b != 0
        at = np.flatnonzero(whole)
        yield mix(code[at]), np.searchsorted(ends, at, "right")


def _split(bodies: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (index of the text, part of it) of a bounded size; long texts are cut between words."""
    at, parts, size = [], [], 0
    for i, body in enumerate(bodies):
        begin = 0
        while begin < len(body):
            end = body.find(b" ", begin + PART) if len(body) - begin > 2 * PART else -1
            end = len(body) if end < 0 else end
            at.append(i)
            parts.append(body[begin:end])
            size += end - begin
            begin = end + 1
            if size >= PART:
                yield at, parts
                at, parts, size = [], [], 0
    if parts:
        yield at, parts


def _positions(grams: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    """Double hashing into a table whose size is a power of two."""
    step = (grams >> _U(33)) | _U(1)
    return [((grams + _U(j) * step) & _U(size - 1)).astype(np.int64) for j in range(hashes)]


def fit(docs: DataFrame, sample: int = 2000, keep: int = 20_000, log_size: int = 18, hashes: int = 3, share: float = 0.3) -> Filters:
    """Build the filters from `docs(text, lang)`.

    sample: at most about this many texts of each language, drawn by a hash of the text, serve for learning (the
    documented bound); n-grams are counted over their whole texts. keep: n-grams held by language at most. share: an
    n-gram counts as one of a language if its frequency there is at least this share of its highest in any language.
    Rows with null lang or text take no part. With nothing to learn from, there are no languages.
    """
    spark = docs.sparkSession
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    totals = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = tuple(sorted(r["lang"] for r in totals))
    if not languages:
        return Filters((), np.zeros((1, 1 << log_size), np.int64), np.zeros(0), hashes, 0)
    index = {c: i for i, c in enumerate(languages)}
    rate = F.create_map([F.lit(x) for r in totals for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            got: dict[int, list[np.ndarray]] = {}
            for at, parts in _split([_clean(x)[0] for x in batch.column(0).to_pylist()]):
                for grams, part in _grams(parts):
                    of = langs[np.array(at)][part]
                    for lang in np.unique(of):
                        got.setdefault(int(lang), []).append(grams[of == lang])
            for lang, grams in got.items():
                values, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.record_batch({"l": pa.array(np.full(values.size, lang)), "g": pa.array(values.view(np.int64)), "n": pa.array(n)})

    counts = drawn.mapInArrow(count, "l long, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = F.create_map([F.lit(x) for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect() for x in (r["l"], float(r["n"]))] or [F.lit(-1), F.lit(1.0)])
    shares = counts.withColumn("f", F.col("n") / total[F.col("l")]).withColumn("top", F.max("f").over(Window.partitionBy("g")))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    chosen = shares.filter((F.col("f") >= share * F.col("top")) & (F.col("n") > 1)).withColumn("r", place).filter(F.col("r") <= keep).select("l", "g").toPandas()
    masks = np.zeros((-(-len(languages) // BITS), 1 << log_size), np.int64)
    for i, grams in chosen.groupby("l")["g"]:
        for pos in _positions(grams.to_numpy(np.int64).view(np.uint64), hashes, masks.shape[1]):
            masks[i // BITS, pos] |= 1 << i % BITS
    load = np.array([np.count_nonzero(masks[i // BITS] >> i % BITS & 1) / masks.shape[1] for i in range(len(languages))])
    return Filters(languages, masks, load, hashes, index[totals[0]["lang"]])


def score_batch(f: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language or 'und', the share of the text's n-grams that it holds) for each text."""
    cleaned = [_clean(x) for x in texts]
    n = len(texts)
    hits, total = np.zeros((n, max(1, len(f.languages)))), np.zeros(n)
    for at, parts in _split([c for c, _ in cleaned]):
        at = np.array(at)
        for grams, part in _grams(parts):
            first, *more = _positions(grams, f.hashes, f.masks.shape[1])
            of = at[part]
            total += np.bincount(of, minlength=n)
            for row, masks in enumerate(f.masks):
                found = masks[first]
                for pos in more:
                    found = found & masks[pos]
                for i in range(BITS * row, min(BITS * (row + 1), len(f.languages))):
                    hits[:, i] += np.bincount(of[(found >> i % BITS) & 1 != 0], minlength=n)
    if not f.languages:
        return ["und"] * n, np.zeros(n)
    wrong = f.load**f.hashes
    right = np.clip((hits - wrong * total[:, None]) / (1 - wrong), 0, None)
    right[:, f.prior] += 1e-9  # texts without any known n-gram, and ties with it, go to the most frequent language
    best = right.argmax(1)
    score = np.clip(right[np.arange(n), best] / np.maximum(total, 1), 0, 1)
    letters = np.array([has for _, has in cleaned], bool)
    return [f.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """`docs` with lang_pred and lang_score; other columns of these names are replaced.

    Texts that are null or have no letter get 'und' and 0. Every row is judged on its own, so repeated rows get equal
    results, and an empty table gives an empty one. The filters (masks of a fixed size) are broadcast.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [x.lower() for x in batch.schema.names].index("text")
            texts = batch.column(at)
            parts = [score_batch(shared.value, texts.slice(lo, 500).to_pylist()) for lo in range(0, len(texts), 500)]
            langs, scores = [x for p, _ in parts for x in p], np.concatenate([p for _, p in parts] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return rows.mapInArrow(judge, schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part` modulo `parts`; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))
