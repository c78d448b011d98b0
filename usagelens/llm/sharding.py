"""Operator 7: stable sharding by jump consistent hashing, with DataFrame functions only.

Law `key`: doc_id and the number of shards decide the shard. With one more
shard a row either stays or moves into the new shard.

Cases: a null doc_id is hashed as 0; a null text has size 16 and the crc32 of no
bytes (0); equal rows get different slots; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: a 64-bit linear congruential step.
STEP = Decimal(2862933555777941757)
WORD = Decimal(2**64)
#: A row visits about ln(shards) shards; more visits than this don't happen in practice.
MOST_VISITS = 128
#: Slices that a shard is numbered in; a prime, so that ids in even steps spread over them.
SLICES = 257


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a bigint key by jump consistent hashing.

    Products are taken in decimal(38), where a 64-bit wrap can be written
    without overflow under ANSI arithmetic.
    """
    unsigned = F.pmod(key.cast("decimal(20,0)"), F.lit(WORD)).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"), unsigned.alias("seed"))

    def visit(state: Column, _: Column) -> Column:
        seed = ((state["seed"] * F.lit(STEP) + F.lit(Decimal(1))) % F.lit(WORD)).cast("decimal(20,0)")
        high = F.floor(seed / F.lit(Decimal(2**33))).cast("double")
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1.0))).cast("bigint")
        moved = F.struct(state["next"].alias("at"), jump.alias("next"), seed.alias("seed"))
        return F.when(state["next"] >= shards, state).otherwise(moved)

    visits = F.sequence(F.lit(1), F.lit(min(shards, MOST_VISITS)))
    return F.aggregate(visits, start, visit)["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, slices: int = SLICES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots are gapless from 0 in each shard. A shard is numbered in `slices`
    slices at once, told by doc_id and text: the counts of the slices (shards x
    slices rows, a fixed bound) give each slice its first slot, so no task sorts
    a whole shard, nor all texts of one doc_id.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint"))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        ((F.pmod(key, F.lit(slices)) + F.crc32(body)) % slices).cast("int").alias("slice"),
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))
        .select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_slot"))
    )
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1)
    slot = (F.col("rank") + F.col("first_slot")).cast("bigint").alias("slot")
    return numbered.join(F.broadcast(first), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", slot, "grown_shard"
    )
