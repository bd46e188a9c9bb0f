"""Sharding by rendezvous hashing: every record key goes to the shard with the highest weighted score.

The score of a shard is ``weight / -ln(u)``, u being a hash of (key, shard) in (0, 1): the shards'
shares are proportional to their weights, and a new shard only takes keys to itself.
DataFrame functions alone; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard 0..len(weights)-1 of a key; equal scores go to the smaller shard.

    A shard of weight 0 gets nothing.  A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = []
    for i, w in enumerate(weights):
        if w:
            # 53 bits of the hash, centred: never 0 or 1
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
            scores.append(F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(-i).alias("minus")))
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot", bucket_rows: int = 100_000) -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without a gap.

    A shard's rows are numbered in hash buckets of about ``bucket_rows`` rows, so no task holds a
    shard; a bucket starts where the rows of the buckets before it end (one count for each shard
    and bucket).  ``order``: columns that fix the order inside a bucket; the first ones deal out
    the rows, so a key whose rows repeat without end should have a further column there.
    """
    buckets = F.greatest(F.lit(1), F.ceil(df.select(F.count(F.lit(1)).alias("n")).scalar() / F.lit(bucket_rows)))
    dealt = df.withColumn("__bucket__", F.pmod(F.xxhash64(*order, F.lit("bucket")), buckets))
    counts = dealt.groupBy(shard, "__bucket__").agg(F.count(F.lit(1)).alias("__n__"))
    before = W.partitionBy(shard).orderBy("__bucket__").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(shard, "__bucket__", F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__from__"))
    inside = F.row_number().over(W.partitionBy(shard, "__bucket__").orderBy(*order)) - 1
    out = dealt.withColumn("__in__", inside).join(counts, [shard, "__bucket__"])
    return out.withColumn(slot, (F.col("__from__") + F.col("__in__")).cast("long")).drop(
        "__bucket__", "__in__", "__from__"
    )


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document row.

    The key and the weights alone decide the shard (law ``key``); ``grown_shard`` is the shard after
    one more of mean weight joins.  size: UTF-8 bytes of the text (a null has none) plus 1.  A null
    key is one key; repeated rows share their shard and take a slot each; an empty table gives an
    empty one; other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
