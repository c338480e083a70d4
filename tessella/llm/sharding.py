"""Rendezvous hashing of record keys over weighted shards, in SQL functions only.

Each (key, shard) pair has a score -weight / ln(u) with u drawn from the pair's MD5; a record goes to the
shard that scores highest. One more shard adds one more score and leaves the others as they are, so the only
records that move are those the new shard wins. Law: ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}/"), key).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.lit(float(weight)) / F.log(u)


def choose(key: Column, weights: list[float]) -> Column:
    """The shard of each key; shards of weight zero get none, and weights are relative."""
    pairs = [F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("back")) for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*pairs)).getField("back")).cast("int")


def sharded(docs: DataFrame, weights: list[float], grown: float = 1.0, buckets: int = 128, parts: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in the shard) and grown_shard (with one more shard).

    Slots are dealt in two steps, so that no task holds a shard: rows are numbered within (shard, bucket of the key, part of the bucket by the text's
    checksum), and the counts of those before (``buckets`` times ``parts`` times shards of them, which are broadcast) are added. So many rows of one id, or without any, are
    numbered in ``parts`` tasks; rows that agree in id and text in one, by an external sort.
    Equal scores (a tie) go to the lower shard. Texts of any length are hashed whole. Null text: size 1, checksum of no bytes. Null ids share the key of the empty string. Equal rows share a
    shard and get slots of their own. Other columns are ignored; an empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    place = F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")
    rows = docs.select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), choose(key, weights).alias("shard"), choose(key, [*weights, grown]).alias("grown_shard"), place.alias("_bucket"))
    # Mixed, as the checksums of one bucket's keys and texts may go together.
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("text_crc32"), F.lit(parts)).cast("int"))
    of = ["shard", "_bucket", "_part"]
    sofar = Window.partitionBy("shard").orderBy("_bucket", "_part")  # at most buckets x parts rows for each shard
    before = rows.groupBy(*of).agg(F.count("*").alias("_n")).select(*of, (F.sum("_n").over(sofar) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*of).orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("_number", number).join(F.broadcast(before), of)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_number") - 1).cast("long").alias("slot"), "grown_shard")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"), [1.0] * 8)
