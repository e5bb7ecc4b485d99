"""Sharding by jump consistent hashing.

A stable key picks its shard by a short walk of jumps, without a ring table; when a shard is added, only the rows that
move into it change place. The generator is the published 64-bit linear congruential one; its product is computed in
limbs of 22 bits, because SQL integers don't wrap around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import written

FACTOR = 2862933555777941757  # of the published generator
LIMB, TOP = 22, 20  # 22 + 22 + 20 bits
ROW_BYTES = 16
#: Jumps done for every row; the rare row that is still under way goes on until it ends.
USUAL_JUMPS = 48


def _limbs(x: int) -> tuple[int, int, int]:
    return x & (1 << LIMB) - 1, x >> LIMB & (1 << LIMB) - 1, x >> 2 * LIMB


def _jump(state: Column, shards: int) -> Column:
    """One jump, unless the walk has left the shards."""
    a0, a1, a2 = _limbs(FACTOR)
    k0, k1, k2 = (state[f"k{i}"] for i in range(3))
    low, high = F.lit((1 << LIMB) - 1), F.lit((1 << TOP) - 1)
    s0 = k0 * a0 + 1
    s1 = k0 * a1 + k1 * a0 + F.shiftright(s0, LIMB)
    s2 = k0 * a2 + k1 * a1 + k2 * a0 + F.shiftright(s1, LIMB)
    r0, r1, r2 = s0.bitwiseAND(low), s1.bitwiseAND(low), s2.bitwiseAND(high)
    upper = F.shiftleft(r2, 11) + F.shiftright(r1, 11)  # the generator's highest 31 bits
    to = F.floor((state["to"] + 1).cast("double") * (F.lit(2.0**31) / (upper + 1).cast("double"))).cast("long")
    moved = F.struct(state["to"].alias("at"), to.alias("to"), r0.alias("k0"), r1.alias("k1"), r2.alias("k2"))
    return F.when(state["to"] >= shards, state).otherwise(moved)


def jump_walk(key: Column, shards: int) -> Column:
    """The walk's end for a 64-bit key: at is the shard, to the next place it would have jumped to."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    low = F.lit((1 << LIMB) - 1).cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"),
        key.bitwiseAND(low).alias("k0"), F.shiftrightunsigned(key, LIMB).bitwiseAND(low).alias("k1"), F.shiftrightunsigned(key, 2 * LIMB).alias("k2"),
    )
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, USUAL_JUMPS))), start, lambda s, _: _jump(s, shards))
    if shards > USUAL_JUMPS:
        walk = F.aggregate(F.when(walk["to"] < shards, F.sequence(F.lit(USUAL_JUMPS), F.lit(shards))).otherwise(F.array().cast("array<int>")), walk, lambda s, _: _jump(s, shards))
    return walk


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key; a null key counts as 0."""
    return jump_walk(key, shards)["at"].cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    The id and the number of shards decide the shard; a null id counts as key 0. Repeated ids share a shard, and each row
    has a slot of its own. Slots count from 0 in a shard in the order of id (nulls first), text_crc32, size. A null text
    has no bytes. An empty table gives no rows; other columns are not read, so their names can't clash.

    Slots come from range partitions: each row has its place within its partition, and the few counts of the partitions'
    shards give the offsets, so no task holds a whole shard.
    """
    walk = jump_walk(F.col("doc_id"), shards)
    text = F.col("text")
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
            "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"), walk.alias("walk"), F.monotonically_increasing_id().alias("rid")
        ).select("doc_id", "size", "text_crc32", F.col("walk.at").cast("int").alias("shard"), F.when(F.col("walk.to") == shards, shards).otherwise(F.col("walk.at")).cast("int").alias("grown_shard"), "rid"),
        "shard-rows",
    )
    order = ["shard", "doc_id", "text_crc32", "size", "rid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's in the lower 33
    placed = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")),
        "shard-placed",
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    # Range partitions cut the sorted shards, so there are at most partitions + shards runs.
    offsets = runs.select("shard", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard"
    )
