"""Helpers shared by the operators: cutting lineage, and bit sets of a fixed size for pre-filters."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there: nothing upstream runs twice or depends on lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Whole texts go to Python so many rows at a time, to bound a task's memory, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bit_set(df: DataFrame, key: Column, log_bits: int) -> np.ndarray:
    """Set bit (key mod 2**log_bits) for each row; the driver gets at most 2**log_bits / 64 words, whatever the input's size."""
    pos = F.pmod(key.cast("long"), F.lit(1 << log_bits))
    words = (
        df.select(pos.alias("p"))
        .selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, cast(p & 63 as int)) AS m")
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
    )
    out = np.zeros(1 << (log_bits - 6), np.int64)
    for w, m in words.toLocalIterator():
        out[w] = m
    return out


def in_bit_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64 or uint64) may be in the set."""
    n = np.uint64(bits.size * 64 - 1)
    pos = keys.view(np.uint64) & n
    return (bits.view(np.uint64)[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) != 0
