"""Multi-party perspective rotation: the same dialogue, once for each participant as the assistant.

In a perspective the participant's turns are the assistant's and are trained on; all other turns are those of named
users, and system turns stay system turns; both are masked out. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256


def _ordered(turns: DataFrame) -> DataFrame:
    """Adds seq, the place of a turn in its conversation, by two levels of counting, so a huge conversation is spread over many tasks."""
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(1 << 60)).cast("long")
    spread = turns.withColumn("chunk", chunk)
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    same = sizes.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "ahead")
    placed = spread.withColumn("at", F.row_number().over(inside) - 1)
    return placed.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).withColumn("seq", F.col("ahead") + F.col("at")).drop("c", "k", "ahead", "at", "chunk", "n")


def _piece(kind: Column, name: Column, text: Column) -> Column:
    """How a turn reads: a header line with its kind, and a user's name, then the text and an end mark."""
    title = F.when(kind == "user", F.concat(F.lit("user "), name)).otherwise(kind)
    return F.concat(F.lit("<|"), title, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def rotate(turns: DataFrame, system: Sequence[str] = ("system",)) -> DataFrame:
    """One row for each turn and each participant of its conversation, from `turns(conv_id, turn, role, text)`.

    perspective: the role that speaks as the assistant; seq: the turn's place; kind: system, assistant or user; piece:
    the rendered turn; body: where in the piece a trained text begins (text and end mark; the header is never trained);
    trained: whether it is the assistant's. Turns are ordered by turn (null last), role and text, so repeated rows stay
    and ties do not matter. A null role is a participant named 'unknown', a null text is empty. A conversation of system
    turns only has no perspective and gives no rows. Other columns are dropped. The result has turns x participants rows.
    """
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    clean = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = clean.filter(~F.col("role").isin(*system)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    full = _ordered(clean).join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    kind = F.when(F.col("role").isin(*system), "system").when(F.col("role") == F.col("perspective"), "assistant").otherwise("user")
    shown = full.withColumn("kind", kind).withColumn("piece", _piece(F.col("kind"), F.col("role"), F.col("text")))
    header = F.length("piece") - F.length("text") - F.length(F.lit("<|end|>\n"))
    return shown.select("conv_id", "perspective", "seq", "role", "kind", "piece", header.cast("long").alias("body"), (F.col("kind") == "assistant").alias("trained"))


def dialogues(rotated: DataFrame, block: int = 512) -> DataFrame:
    """(conv_id, perspective, block, n_turns, text, spans): whole dialogues, in blocks of at most `block` turns.

    spans: (begin, end) in characters of what is trained on, within the block's text, in order. A dialogue of up to
    `block` turns is one row; a longer one goes on in further rows, so that no row grows without bound.
    """
    turn = F.struct("seq", "piece", "body", "trained")
    rows = rotated.withColumn("block", F.floor(F.col("seq") / block)).groupBy("conv_id", "perspective", "block").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    text = F.array_join(F.transform("t", lambda t: t.piece), "")
    grown = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)").alias("spans")),
        lambda s, t: F.struct(
            (s.at + F.length(t.piece)).alias("at"),
            F.when(t.trained, F.concat(s.spans, F.array(F.struct((s.at + t.body).alias("begin"), (s.at + F.length(t.piece) - 1).alias("end"))))).otherwise(s.spans).alias("spans"),
        ),
    )
    return rows.select("conv_id", "perspective", "block", F.size("t").cast("long").alias("n_turns"), text.alias("text"), grown.spans.alias("spans"))
