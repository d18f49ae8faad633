"""Sharding by jump consistent hashing: a stable key and the number of shards decide the shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gapless, with_counts

SHARDS = 24


def mix64(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (the finaliser of SplitMix64), so that runs of ids don't stay together."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys: no ring, and a shard more takes 1 / (shards + 1) of the keys, into itself only."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state))
    jump = np.zeros(len(state), np.int64)
    while len(open_):
        at[open_] = jump[open_]
        s = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        state[open_] = s
        to = (at[open_] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))
        jump[open_] = np.minimum(to, 2.0**62).astype(np.int64)
        open_ = open_[jump[open_] < shards]
    return at.astype(np.int32)


def shard_documents(df: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """A row per row of ``df`` (doc_id, text): size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: mixed doc_id and shard count decide alone, so equal ids go to one shard, wherever their rows
    lie. ``slot`` numbers a shard's rows from 0 without gaps; it is counted per task and offset by the counts of
    earlier tasks, so no task ever holds a shard. A null text has size 8 and CRC 0, as an empty one; a null doc_id is
    placed as id -1 is; repeated rows each have a slot; extra columns are ignored; an empty table gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "sharding")

    @F.pandas_udf("shard int, grown_shard int")
    def place(ids: pd.Series) -> pd.DataFrame:
        keys = mix64(ids.fillna(-1).to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + 1)})

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))).alias("p"),
    ).select("doc_id", "size", "text_crc32", "law", "p.shard", "p.grown_shard")
    written = scratch.table(with_counts(placed, "shard"), "placed")
    return gapless(written, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_shard_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
