"""A corpus pipeline: five stages, each on all that the one before kept, with Parquet between them.

All stages but the last return the columns of `documents`, extra ones too. Filters judge every row by its text, so null
and repeated doc_ids do no harm; one that removes documents by doc_id (jaccard, decontamination) removes all rows of it
and keeps rows without one. Null and empty texts go in the language stage. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequire.llm import decontaminate, jaccard, language, mixing, registry, toxicity
from pagequire.llm.store import cut, shared_dir

#: Texts of which the best language holds a smaller share of n-grams are in no language that was learned.
LEAST_LANGUAGE = 0.25


#: Up to so many ids (8 MB) are broadcast against the documents; more are joined by a shuffle.
FEW_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the ids; a null doc_id stays."""
    ids = cut(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity score below 0.5 stay; the model learns from the given labels of these documents."""
    model = registry.toxicity_model(docs, registry.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("tox_score < 0.5").drop("tox_score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in some learned language stay; null texts, those without a letter and gibberish go."""
    judged = language.identify(docs, registry.language_filters(docs))
    return judged.filter(f"lang_pred <> 'und' AND lang_score >= {LEAST_LANGUAGE}").drop("lang_pred", "lang_score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, in all rows that have it; a null doc_id is its own group."""
    groups = jaccard.join(docs.select(F.col("doc_id").alias("id"), "text"))
    copies = groups.filter("component <> id").select(F.col("id").alias("doc_id")).distinct()
    return _without(docs, copies)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not contaminate stay; of a repeated doc_id, no row does if one is contaminated."""
    items = registry.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    judged = decontaminate.judge(docs.select(F.col("doc_id").alias("row"), "text"), items)
    bad = judged.filter("contaminated").select(F.col("row").alias("doc_id")).distinct()
    return _without(docs, bad)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with its size, its source's target, its shard and its place there.

    Rows whose doc_id is null or not theirs alone go by numbers below all ids, and keep what they have.
    """
    below = F.lit(docs.agg(F.coalesce(F.least(F.lit(0), F.min("doc_id")), F.lit(0))).first()[0]).cast("long") - 1
    repeated = cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    repeated = F.broadcast(repeated) if repeated.count() <= FEW_IDS else repeated
    odd = docs.filter("doc_id IS NULL").unionByName(docs.join(repeated, "doc_id", "left_semi"))
    odd = cut(odd.withColumn("key_", below - F.monotonically_increasing_id()))
    own = docs.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti")
    keyed = own.withColumn("key_", F.col("doc_id").cast("long")).unionByName(odd)
    order = F.xxhash64("doc_id", "source", "text")
    sized = cut(keyed.select(F.col("key_").alias("key"), "source", mixing.n_words(F.col("text")).alias("size"), order.alias("order")))
    mix = mixing.mix(sized).select(F.col("key").alias("key_"), "size", "target", "repeat", "shard", "place")
    clash = [c for c in keyed.columns if c.lower() in ("size", "target", "repeat", "shard", "place")]
    return keyed.drop(*clash).join(mix, "key_").drop("key_")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("jaccard", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: Two stages learn a classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
