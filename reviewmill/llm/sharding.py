"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and one more shard moves only its share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import blocks_for, free_name, materialise, prefix_sums, ship

#: The generator's multiplier in the published algorithm.
_LCG = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key (int64), 0 to shards - 1. Keys are mixed first, so that consecutive ids spread evenly."""
    x = keys.astype(np.int64).view(np.uint64).copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        shard, jump = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            shard[live] = jump[live]
            x[live] = x[live] * _LCG + np.uint64(1)
            jump[live] = ((shard[live] + 1) * (2.0**31 / ((x[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[jump[live] < shards]
    return shard


def shard_of(key, shards: int):
    """Column: shard of a long key. A null key counts as -1."""

    @F.pandas_udf(IntegerType())
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(-1).cast("long")))


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Shard of every row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8; a null text is empty. grown_shard: the shard when there is one more.
    slot: the row's place in its shard, gapless from 0, counted in blocks so that no task holds a shard.
    Rows with one doc_id share a shard and have slots of their own; null doc_ids share the shard of -1. An empty
    table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    text, key = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    rows = materialise(
        docs.select(
            key,
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    # ids may be null or repeat, and so may rows: their number parts those
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(blocks_for(rows.count() // shards)))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return prefix_sums(rows.withColumn("block", block), ["shard"], "block", order, F.lit(1).cast("long"), "slot").drop("block", "row")


def write_shards(docs: DataFrame, shards: int, path: str, name: str = "shard") -> None:
    """Writes all columns of docs to one folder a shard. A shard's rows come from many tasks, so a hot one isn't one task's.

    name: the folders' column, which docs must not have already.
    """
    if free_name(docs, name) != name:
        raise ValueError(f"docs have a column {name}; give another name for the shards")
    ship(docs.sparkSession)
    docs.withColumn(name, shard_of(F.col("doc_id"), shards)).write.partitionBy(name).parquet(path)
