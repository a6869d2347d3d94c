"""The queries of this subpackage, one for each operator, over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, licences, linkgraph, manifest, mixing, pieces, repair, sql, topk, toxicity, warc
from .store import cut, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_filters(docs: DataFrame) -> language.Filters:
    return language.fit(docs.filter(~language.held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = language.identify(docs.select("doc_id", "text"), language_filters(docs))
    return judged.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on a bounded draw of the labelled rows whose crc32(doc_id) modulo 5 is not 0; the draw's ids are broadcast, no text is shuffled."""
    fold = labels.filter(F.col("toxic").isNotNull() & ~language.held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    drawn = F.broadcast(cut(toxicity.draw(fold)))
    return toxicity.fit(cut(docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "toxic")))


def op8_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = toxicity.score(docs.select("doc_id", "text"), toxicity_model(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", language.held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return jaccard.join(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    vectors = rows.select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> try_cast(floor(256 * cast(x as double)) as bigint))").alias("v"))
    found = topk.search(vectors, vectors.filter("id % 50 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    got = decontaminate.judge(docs.select(F.col("doc_id").alias("row"), "text"), items)
    return got.select(F.col("row").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole dialogues from each participant's perspective, with the character ranges that are trained on as `begin-end,...`."""
    told = chat.dialogues(chat.rotate(table(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.begin, s.end)), ",")
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return told.select("conv_id", "perspective", "block", "n_turns", "text", spans.alias("spans"), trained.alias("n_trained"))


RULES = (
    linkgraph.Rule("allow", "org", "/"),
    linkgraph.Rule("block", "example.org", "/es/"),
    linkgraph.Rule("block", "example.org", "/en/1"),
    linkgraph.Rule("allow", "com", "/fr/"),
    linkgraph.Rule("block", "com", "/de/"),
)


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linkgraph.verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return got.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken, and in addition how often, in which shards and at which places there a document stands (`shard:place,...`, in order)."""
    docs = table(spark, sf_dir, "documents")
    # rows may share a doc_id or have none; what they hold orders them, so that reruns agree
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("order"))
    sized = cut(sized.withColumn("key", F.monotonically_increasing_id()))
    drawn = mixing.mix(sized).groupBy("key").agg(F.sum("size").alias("taken"), F.count("*").alias("times"), F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("at"))
    plan = mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), (5, 2, 1), 1.5, 2.0).withColumnRenamed("source", "s")
    full = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).join(drawn, "key", "left")
    places = F.array_join(F.transform("at", lambda x: F.concat_ws(":", x.shard, x.place)), ",")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("times", F.lit(0)).alias("times"), F.coalesce(places, F.lit("")).alias("places"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether the leaf still leads to the root after some rows were tampered with."""
    docs = table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    enters = {c: manifest.field(F.col(c)) for c in names}
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = manifest.digest([manifest.field(F.col("n_chars").cast("decimal(20,0)") + 1) if c == "n_chars" else enters[c] for c in names])
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), manifest.digest(list(enters.values())).alias("leaf"), F.when(changed & F.col("n_chars").isNotNull(), tampered).alias("tampered"))
    placed = manifest.manifest(leaves)
    folded = manifest.fold(F.col("path"), F.coalesce("tampered", "leaf"))
    told = placed.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which some are dropped, emptied, without sentence ends, repeated or a user's; nulls in role and text are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest repair and a digest of what it gives."""
    turns = table(spark, sf_dir, "conversations")
    told, rows = repair.repair(damaged(turns))
    g = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g")
    every = turns.select("conv_id", g).distinct().join(told.drop("conv_id"), "g", "left").join(repair.digests(rows), "g", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Where the vocabulary file of op13 is; `public_tokenizers` knows, and the file is never copied.
PIECES = "piece_bpe_32k.model"


def op13_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document's tokens, and what they decode to, as digests."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(PIECES)
    docs = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    told = pieces.decode(docs, model)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
