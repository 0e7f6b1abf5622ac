"""Shards by jump consistent hashing of a stable key.

The key is mixed to 64 bits and then jumps through ever larger bucket numbers
until it would leave the range. With one more shard a row either stays or goes
to the new shard, so no ring table has to be kept anywhere.

Edge cases: a null key hashes as 0, so rows without one go to the shard of 0; a null or empty text has size 16 and the
checksum 0; repeated rows each get a slot of their own; an empty table gives an
empty result; further columns of the input are ignored by shard_documents().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.operators.tables import running_total

JUMP_FACTOR = 2862933555777941757
OVERHEAD_BYTES = 16


def jump_buckets(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * np.uint64(JUMP_FACTOR) + np.uint64(1)
        step = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        target = np.floor((bucket[moving] + 1) * (float(1 << 31) / step)).astype(np.int64)
        inside = target < n_shards
        moving = moving[inside]
        bucket[moving] = target[inside]
    return bucket


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard of a long key."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(keys.to_numpy(np.int64).view(np.uint64), n_shards), dtype="int32")

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: its size, checksum, shard, place in the shard, and its shard if there were one more.

    ``slot`` numbers the rows of a shard from 0 without gaps. A shard is numbered
    in 4096 pieces by a digest of the row, so that neither it nor the rows of one key need fit in a task.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(data) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = rows.withColumn("shard", jump_shard(F.col("doc_id"), n_shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), n_shards + 1))
    rows = rows.withColumn("_chunk", F.substring(F.md5(F.concat_ws(":", "doc_id", "size", "text_crc32")), 1, 3))
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = running_total(rows, ["shard"], "_chunk", order, F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
