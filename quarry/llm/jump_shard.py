"""Sharding by jump consistent hashing.

A key's shard is a function of the key and the shard count alone, with no ring
table: the hash walks forward through the shard counts at which the key would
have moved and stops at the last one below the count. When one shard is
appended a key either stays or moves into the new shard, and 1/(n+1) of the
keys move.

Defined cases: a null key hashes as its own fixed key; equal keys share a
shard whatever their text; an empty table gives an empty result; columns of
the input that clash with result names are ignored (only the named key and
text columns are read).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.plans.sizing import materialize

# Fixed value: multiplier of the published jump hash generator.
JUMP_MULTIPLIER = 2862933555777941757
#: Rows that one rank window should hold at most.
BLOCK_ROWS = 200_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys, vectorised over the keys that still move."""
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump[live]
            key[live] = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            step = (1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((shard[live] + 1).astype(np.float64) * step).astype(np.int64)
            live = live[jump[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long key column."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(s):
        import pandas as pd
        return pd.Series(jump_hash(s.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def stable_key(df: DataFrame, col: str) -> Column:
    """Long key: integers as they are (null: -1), other types by XXH64."""
    kind = dict(df.dtypes)[col]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(col).cast("long"), F.lit(-1).cast("long"))
    return F.xxhash64(F.col(col))


def assign_shards(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 8,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes + 1; null text: 1),
    text_crc32 (null text: of the empty text), shard, grown_shard (with one more
    shard) and slot: the row's gapless position in its shard, by (key,
    text_crc32, size).

    The text is reduced to its size and checksum in the scan, so only narrow
    rows are ranked. Ranks come from blocks of consecutive keys (see
    ``common.ranked_in_groups``), so a shard is never sorted in one task.
    """
    spark = df.sparkSession
    common.prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key_col).alias("doc_id"), stable_key(df, key_col).alias("__key"),
        F.when(F.col(text_col).isNull(), F.lit(1)).otherwise(F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"))
    rows = materialize(rows.withColumn("shard", shard_of(F.col("__key"), shards))
                       .withColumn("grown_shard", shard_of(F.col("__key"), shards + 1)), "shards")
    n = rows.count()
    bounds = common.split_bounds(rows, "__key", -(-n // block_rows))
    rows = rows.withColumn("__block", common.block_of(F.col("__key"), bounds))
    return common.ranked_in_groups(rows, "shard", ["__key", "text_crc32", "size"], "__block", "slot") \
        .drop("__block", "__key")
