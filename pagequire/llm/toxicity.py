"""Toxicity scores from a classifier that is trained to ignore which group a text names.

Features are the words of a text and their first 4 to 6 bytes. A logistic regression over the most telling ones is
fitted with one more penalty: each training text that names a group is copied with the term swapped for another of its
kind, and the squared change of the logit between a text and its copies is added to the loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, modest_batches
from .words import ALNUM, hashed

PREFIXES = (4, 5, 6)
#: Identity terms, each line a kind whose members may stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted uint64
    weights: np.ndarray
    bias: float
    named: int = 0  # drawn texts that name a group, so have copies; with none, the penalty does nothing


def features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, the text each is in), with repeats."""
    words, heads, counts = hashed([x.lower().encode("utf-8", "replace") if x else None for x in texts], ALNUM, PREFIXES)
    of = np.repeat(np.arange(len(texts)), counts)
    parts = [(words, of)] + [(h[h != 0], of[h != 0]) for h in heads]
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


class _Swaps:
    def __init__(self, kinds: Sequence[Sequence[str]]):
        self.next: dict[str, list[str]] = {}
        for kind in kinds:
            for i, term in enumerate(kind):
                self.next.setdefault(term, []).extend([kind[(i + 1) % len(kind)], kind[(i + 2) % len(kind)]])
        self.found = re.compile(r"\b(" + "|".join(sorted(map(re.escape, self.next), key=len, reverse=True)) + r")\b")

    def copies(self, text: str) -> list[str]:
        """Two counterfactual copies of a lower-cased text that names a group, else none."""
        if not self.found.search(text):
            return []
        return [self.found.sub(lambda m, k=k: self.next[m[1]][k], text) for k in (0, 1)]


def _logit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _largest(x: np.ndarray) -> float:
    """Largest eigenvalue of x'x by power iteration."""
    v = np.full(x.shape[1], 1 / max(1, x.shape[1]) ** 0.5, np.float32)
    size = 0.0
    for _ in range(30 if len(x) else 0):
        u = x.T @ (x @ v)
        size = float(np.linalg.norm(u))
        v = u / max(size, 1e-12)
    return size


def _descend(x: np.ndarray, y: np.ndarray, change: np.ndarray, ridge: float, fair: float, steps: int) -> tuple[np.ndarray, float]:
    """Minimise the log loss + ridge / 2 |w|^2 + fair * mean (change w)^2 by accelerated gradient steps."""
    n, d = x.shape
    m = max(1, len(change))
    rate = 1 / (0.3 * (_largest(x) / n + 1) + ridge + 2.2 * fair * _largest(change) / m)
    w = ahead = np.zeros(d, np.float32)
    b = b_ahead = 0.0
    for k in range(steps):
        off = _logit(x @ ahead + b_ahead) - y
        g = x.T @ off / n + ridge * ahead + 2 * fair * (change.T @ (change @ ahead)) / m
        new, b_new = (ahead - rate * g).astype(np.float32), b_ahead - rate * float(off.mean())
        ahead, b_ahead = new + k / (k + 3) * (new - w), b_new + k / (k + 3) * (b_new - b)
        w, b = new, b_new
    return w, b


def draw(labels: DataFrame, sample: int = 3000) -> DataFrame:
    """About `sample` rows of each class of `labels(doc_id, toxic)`, by a hash of doc_id: few enough to be broadcast to the texts."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").distinct()
    rate = {r["toxic"]: min(1.0, sample / r["count"]) * (1 << 20) for r in known.groupBy("toxic").count().collect()}
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0))))


def fit(labelled: DataFrame, sample: int = 3000, keep: int = 2000, ridge: float = 1e-3, fair: float = 1.0, steps: int = 400, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """Learn from `labelled(text, toxic)`; rows with null text or a label other than 0 and 1 take no part.

    sample: about this many texts of each class, drawn by a hash of the text, serve for learning (the documented bound;
    the driver holds sample x keep numbers); whole texts are read. keep: features, those whose share of texts differs
    most between the classes; the features of identity terms are always among them. fair: weight of the counterfactual
    penalty. With one class only, every text gets that class's side of 0.5; with none, the score is 0.
    """
    known = labelled.filter("text IS NOT NULL AND toxic IN (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 4.0 if 1 in totals else -40.0)
    rate = {k: min(1.0, sample / v) for k, v in totals.items()}
    share = F.when(F.col("toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0])) * (1 << 20)
    drawn = cut(known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share))
    n = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    swaps = _Swaps(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            f, of = features(batch.column(0).to_pylist())
            pairs = _distinct(f, of)
            values, inverse = np.unique(pairs[0], return_inverse=True)
            bad = np.bincount(inverse, y[pairs[1]], values.size).astype(np.int64)
            every = np.bincount(inverse, minlength=values.size)
            yield pa.record_batch({"f": pa.array(values.view(np.int64)), "bad": pa.array(bad), "good": pa.array(every - bad)})

    counts = drawn.mapInArrow(count, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    p1, p0 = F.col("bad") / F.lit(float(max(n.get(1, 0), 1))), F.col("good") / F.lit(float(max(n.get(0, 0), 1)))
    telling = counts.filter("bad + good >= 3").withColumn("d", (p1 - p0) * (p1 - p0) / (p1 + p0)).orderBy(F.desc("d"), "f").limit(keep)
    chosen = telling.select("f").toPandas()["f"].to_numpy(np.int64).view(np.uint64)
    named, _ = features([t for kind in kinds for t in kind])
    chosen = np.unique(np.concatenate([chosen, named]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = text.lower()
                versions = [low, *swaps.copies(low)]
                f, of = _distinct(*_chosen(chosen, *features(versions)))
                rows.append((y, [np.searchsorted(chosen, f[of == i]).tolist() for i in range(len(versions))]))
            yield pa.record_batch({"y": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32())))})

    rows = sorted(drawn.mapInArrow(vectors, "y int, x array<array<int>>").collect(), key=lambda r: (r["y"], r["x"]))
    x, change = np.zeros((len(rows), chosen.size), np.float32), []
    for i, r in enumerate(rows):
        x[i, r["x"][0]] = 1
        for copy in r["x"][1:]:
            d = -x[i]
            d[copy] += 1
            change.append(d)
    y = np.array([r["y"] for r in rows], np.float32)
    w, b = _descend(x, y, np.array(change, np.float32).reshape(-1, chosen.size), ridge, fair, steps)
    return Model(chosen, w.astype(np.float64), float(b), sum(len(r["x"]) > 1 for r in rows))


def _chosen(wanted: np.ndarray, f: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the features that are wanted (sorted); a bit table by leading bits spares most look-ups."""
    if not wanted.size or not f.size:
        return f[:0], of[:0]
    table = np.zeros(1 << 18, bool)
    table[(wanted >> np.uint64(46)).astype(np.int64)] = True
    near = np.flatnonzero(table[(f >> np.uint64(46)).astype(np.int64)])
    f, of = f[near], of[near]
    at = np.minimum(np.searchsorted(wanted, f), wanted.size - 1)
    hit = wanted[at] == f
    return f[hit], of[hit]


def _distinct(f: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each text."""
    order = np.lexsort((f, of))
    f, of = f[order], of[order]
    new = np.ones(f.size, bool)
    new[1:] = (f[1:] != f[:-1]) | (of[1:] != of[:-1])
    return f[new], of[new]


def score_batch(m: Model, texts: Sequence[str | None]) -> np.ndarray:
    out = np.full(len(texts), m.bias)
    for lo in range(0, len(texts), 256):
        f, of = _distinct(*_chosen(m.features, *features(texts[lo : lo + 256])))
        if f.size:
            np.add.at(out, of + lo, m.weights[np.searchsorted(m.features, f)])
    return _logit(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with tox_score (0 to 1); another column of that name is replaced.

    Null and empty texts get the score of a text without features. Rows are scored on their own: repeated rows score
    alike, an empty table gives an empty one. The model (a bounded number of weights) is broadcast.
    """
    modest_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c.lower() != "tox_score"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [x.lower() for x in batch.schema.names].index("text")
            texts = batch.column(at)
            got = np.concatenate([score_batch(shared.value, texts.slice(lo, 256).to_pylist()) for lo in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "tox_score"])

    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields, T.StructField("tox_score", T.DoubleType())]))
