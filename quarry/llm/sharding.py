"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard depends on the key and the number of shards alone. Adding one shard moves rows only into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import repeat_rows, running_total

#: Halves of the generator's multiplier 2862933555777941757; the lower half is split again into 16-bit parts.
_A_HIGH, _A_LOW1, _A_LOW0 = 0x27BB2EE6, 0x87B0, 0xB0FD
_MASK = 0xFFFFFFFF
#: Most jumps that are followed; a key that needs more raises an error. Their number is a sum of independent trials with mean ln(shards):
#: 22 for 2**31 shards, and over 256 in less than one of 10**100 keys.
MAX_JUMPS = 256
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a long key among ``shards`` and among ``shards + 1``; null for a null key.

    The 64-bit generator runs on two 32-bit halves, so that no product overflows in ANSI mode.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        long(0).alias("shard"), long(0).alias("grown"), F.lit(0.0).alias("next"),
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(long(_MASK)).alias("low"),
    )

    def jump(s: Column, _: Column) -> Column:
        h, l = s["high"], s["low"]
        t1 = l * long(_A_LOW1)
        total = l * long(_A_LOW0) + F.shiftleft(t1.bitwiseAND(long(0xFFFF)), 16) + long(1)
        low = total.bitwiseAND(long(_MASK))
        high = (
            F.shiftright(total, 32) + F.shiftright(t1, 16) + h * long(_A_LOW0)
            + F.shiftleft((h * long(_A_LOW1)).bitwiseAND(long(0xFFFF)), 16) + l * long(_A_HIGH)
        ).bitwiseAND(long(_MASK))
        to = s["next"].cast("long")
        after = F.floor((to + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(
            F.when(to < shards, to).otherwise(s["shard"]).alias("shard"), to.alias("grown"), after.cast("double").alias("next"),
            high.alias("high"), low.alias("low"),
        )
        return F.when(s["next"] <= shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards + 1, MAX_JUMPS)))

    def end(s: Column) -> Column:
        grown = F.when(s["next"] <= shards, F.raise_error(F.lit("a key needs too many jumps")).cast("int")).otherwise(s["grown"].cast("int"))
        return F.struct(s["shard"].cast("int").alias("shard"), grown.alias("grown"))

    return F.aggregate(steps, start, jump, end)


def shard_key(df: DataFrame, key: str) -> Column:
    """A long from a stable key: integers as they are, other types by xxhash64; a null key counts as 0."""
    k = F.col(key)
    return F.coalesce(k.cast("long") if isinstance(df.schema[key].dataType, _INTEGRAL) else F.xxhash64(k), F.lit(0).cast("long"))


def assign_shards(df: DataFrame, key: str, shards: int, shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """df with its shard, and with ``grown_col`` the shard after one more is appended. Nothing is shuffled.

    Any other columns stay; columns that have the new names are replaced. Rows with a null key share the shard of key 0.
    """
    jump = jump_hash(shard_key(df, key), shards)
    out = df.withColumn("__jump", jump).withColumn(shard_col, F.col("__jump.shard"))
    if grown_col:
        out = out.withColumn(grown_col, F.col("__jump.grown"))
    return out.drop("__jump")


def number_slots(df: DataFrame, shard_col: str, slot_col: str, buckets: int = 256) -> DataFrame:
    """df with gapless slots from 0 in each shard. Equal rows are counted first, so neither a hot shard nor a hot row needs one task.

    An empty table stays empty; equal rows get consecutive slots.
    """
    cols = [c for c in df.columns if c != slot_col]
    counted = df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    order = [c for c in cols if c != shard_col]
    begun = running_total(counted, [shard_col], order, "__n", "__first", buckets)
    return repeat_rows(begun, "__n", "__copy").withColumn(slot_col, F.col("__first") + F.col("__copy")).select(*cols, slot_col)


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """op2: one row per document row with its size, checksum, shard and slot. A null text has size 8 and the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = assign_shards(rows, "doc_id", shards, "shard", "grown_shard")
    return number_slots(placed, "shard", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
