"""Sharding by jump consistent hashing, in Spark expressions.

The key seeds a 64-bit linear congruential generator; each draw jumps to a later bucket until the jump leaves the
shards (Lamping and Veach, 2014).  There is no ring table, and a shard appended at the end takes rows only into itself.
Products modulo 2**64 are taken in 16-bit limbs, because Spark's checked arithmetic does not wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import parts_for, whole_text

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
BLOCK_ROWS = 1_000_000


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64."""
    a = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    m = [(MULTIPLIER >> 16 * i) & 0xFFFF for i in range(4)]
    limbs, carry = [], F.lit(1).cast("long")
    for k in range(4):
        total = carry
        for i in range(k + 1):
            total = total + a[i] * F.lit(m[k - i]).cast("long")
        limbs.append(F.shiftleft(total.bitwiseAND(0xFFFF), 16 * k))
        carry = F.shiftrightunsigned(total, 16)
    return limbs[0].bitwiseOR(limbs[1]).bitwiseOR(limbs[2]).bitwiseOR(limbs[3])


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a long key; a null key counts as 0.

    A key needs at most ``shards`` jumps, since every jump goes forward, so the fold below always reaches the end.
    """
    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"),
                     F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"))

    def step(state: Column, _: Column) -> Column:
        moved = F.transform(F.array(_next_key(state["key"])), lambda k: F.struct(
            k.alias("key"), state["jump"].alias("at"),
            F.floor((state["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + 1)))
            .cast("long").alias("jump")))
        return F.when(state["jump"] < shards, moved[0]).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps.  Rows are numbered inside blocks (a hash of the row, about
    ``block_rows`` each) and the rows of earlier blocks are added from a table with one row per shard and block, so
    no task holds a shard.  Repeated rows get slots of their own.  A null text is empty, a null id is key 0, other
    columns are ignored, an empty table gives an empty table.
    """
    data = whole_text(text_col).cast("binary")
    blocks = parts_for(docs.count(), block_rows, 16)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("crc"), jump_hash(F.col(id_col), shards).alias("shard"),
        jump_hash(F.col(id_col), shards + 1).alias("grown"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy("id", "size", "crc")
    return (rows.withColumn("place", F.row_number().over(inside).cast("long") - 1).join(before, ["shard", "block"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"),
                    "shard", (F.col("before") + F.col("place")).alias("slot"), F.col("grown").alias("grown_shard")))
