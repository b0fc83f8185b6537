"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table

#: Production parameter of op5.
SHARDS = 24
_BUCKETS = 1024


def _cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a uniform u that key and shard decide; the least cost wins the record."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: each shard draws a cost, the least wins, ties go to the smaller shard.

    A shard's share is proportional to its weight. A further shard only adds a draw, so records move into it
    and nowhere else; a removed shard's records alone move.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(F.array(*[F.struct(_cost(key, i, w).alias("c"), F.lit(i).alias("s")) for i, w in enumerate(weights)]))["s"]


def shard(docs: DataFrame, weights: list[float], grown: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id_col, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    shard: from the id and the weights alone (law `key`); so equal texts with different ids may part.
    slot: the record's place in its shard, gapless from 0, in order of a hash bucket and then id.
    grown_shard: the shard if one more of weight `grown` (default: the mean weight) were added.
    size: UTF-8 bytes plus 8; null texts have none, their crc32 is that of the empty text. Rows without an
    id share the shard of the null key. Repeated rows have the same shard and slots of their own.
    Other columns are ignored. An empty table gives an empty result.

    Slots come from counts per (shard, bucket), so no shard is ever in one task; counting reads ids only.
    """
    more = [*weights, sum(weights) / len(weights) if grown is None else grown]
    key = F.col("_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).alias("_id")).select("_id", rendezvous(key, weights).alias("shard"))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = rows.select("*", rendezvous(key, weights).alias("shard"), rendezvous(key, more).alias("grown_shard"))
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(_BUCKETS)).cast("int")
    out = numbered(rows, "shard", bucket, ["_id", "text_crc32", "size"], "slot", ids)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
