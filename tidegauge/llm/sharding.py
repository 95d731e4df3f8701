"""Jump consistent hashing: stable keys to shards, without a ring.

Each key starts a pseudo-random sequence of jumps to ever larger shard numbers; the
last jump below the number of shards is its shard.  A shard appended takes rows
only into itself, about 1/(n+1) of every other.

Everything is DataFrame expressions.  Slots (positions within a shard) come from
counts per (shard, bucket): only a bucket of a shard is ever sorted in one task.

The key is the document's id.  A null id is keyed by its text's hash, so that such
rows spread as well.  A null text has no bytes; size is the UTF-8 bytes plus 16.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the 64-bit linear congruential generator that the published method uses.
MULTIPLIER = "2862933555777941757"
#: Parts of a shard for the numbering of its slots; each is sorted in one task.
BUCKETS = 256


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards``-1 of a 64-bit key.

    The generator's product needs 126 bits, which decimal(38,0) holds exactly.  At
    most ``shards`` jumps are needed and few are made, so the steps are nested: one
    that is not needed costs a comparison.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    wide = lambda c: c.cast("decimal(20,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    state = F.struct(wide(F.when(key < 0, wide(key) + two64).otherwise(wide(key))).alias("k"),
                     F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column) -> Column:
        product = s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        k = (product % two64).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33)).cast("double") + 1.0
        return F.struct(k.alias("k"), s["j"].alias("b"),
                        F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / high)).cast("long").alias("j"))

    side = math.isqrt(shards - 1) + 1
    step = lambda s, _: F.when(s["j"] >= shards, s).otherwise(jump(s))
    steps = F.sequence(F.lit(1), F.lit(side))
    rounds = lambda s, _: F.when(s["j"] >= shards, s).otherwise(F.aggregate(steps, s, step))
    return F.aggregate(steps, state, rounds, lambda s: s["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``law`` is ``key``: id and number of shards decide.  ``grown_shard`` is the shard
    with one more.  Slots are gapless from 0 in each shard, ordered by bucket, id and
    text; equal rows stand in any order.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(
        docs[doc_id].alias("doc_id"), F.octet_length(body).cast("long").alias("__bytes"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(docs[doc_id].cast("long"), F.xxhash64(body)).alias("__key"),
    ).select(
        "doc_id", (F.col("__bytes") + 16).alias("size"), "text_crc32", F.lit("key").alias("law"),
        jump_shard(F.col("__key"), shards).alias("shard"), jump_shard(F.col("__key"), shards + 1).alias("grown_shard"),
        # Equal ids may be many, so the text has a say as well.
        F.xxhash64("__key", "text_crc32").alias("__mix"),
    )
    rows = rows.withColumn("__bucket", F.pmod("__mix", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(
        Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    place = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("__place", F.row_number().over(place) - 1)
            .join(before.select("shard", "__bucket", "__before"), ["shard", "__bucket"])
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    (F.coalesce("__before", F.lit(0)) + F.col("__place")).cast("long").alias("slot"), "grown_shard"))

