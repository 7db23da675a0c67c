"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform draw u from a digest of both; the shard with the
highest score weight / -ln(u) owns the key. A further shard can only win keys, so growing the
count moves rows into the new shard alone. All steps are DataFrame expressions.

Defined cases: a null key hashes as the word ``null``; a null text has size 1 and CRC 0;
repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import read_table

#: Row groups that a shard is dealt into so that slots are numbered in parallel.
SLOT_GROUPS = 2048
#: Copies of one row that are unfolded from one array.
COPY_BLOCK = 4096


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the owning shard of ``key``; ties go to the higher number (never seen in 52 bits)."""
    named = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be positive")
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard-{shard}"), named), 12)
        u = (draw.cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_documents(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, groups: int = SLOT_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    Equal rows are counted before they are dealt out, so that a key that holds a large
    share of all rows costs one row per map task in the shuffle.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = counted.select(
        "*",
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(groups)).cast("int").alias("slot_group"),
    )
    totals = placed.groupBy("shard", "slot_group").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("slot_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "slot_group", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "slot_group").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("upto", F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # at most len(weights) * groups rows, whatever the table's size
    joined = numbered.join(F.broadcast(offsets), ["shard", "slot_group"])
    # copies of a row come back block by block, so that no array holds them all
    last = F.col("offset") + F.col("upto") - 1
    blocks = joined.withColumn("last", last).withColumn("from", F.explode(F.sequence(last - F.col("copies") + 1, last, F.lit(COPY_BLOCK).cast("long"))))
    return blocks.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard",
        F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPY_BLOCK - 1, F.col("last")))).alias("slot"),
    ).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), [1.0] * 8)
