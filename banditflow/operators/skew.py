"""Cap the chunk size of hot keys (a semantic salt: chunks start from the same state)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditflow.operators.ordering import key_index
from banditflow.session import materialize, release


#: A span lies in buckets no wider than itself and less than so many times narrower.
STEP_BITS = 2


@dataclass
class ChunkNumbers:
    """Where the chunks of the hot keys lie; None: no key has more than ``max_limit`` rows, all chunks are 0."""

    spans: DataFrame | None = None  # key, bucket (level, at), chunk, first, last order number: at most two rows a (key, bucket)
    levels: DataFrame | None = None  # key, levels of its buckets
    chunks: DataFrame | None = None  # key, n_chunks, of the hot keys

    def release(self) -> None:
        release(self.spans, self.levels, self.chunks)


def _bucket(order: Column, level: Column) -> Column:
    """The bucket of 2^level order numbers that ``order`` lies in."""
    return F.struct(level.alias("level"), F.call_function("shiftright", F.floor(order).cast("long"), level).alias("at"))


def chunk_numbers(narrow: DataFrame, key: str, order: str, max_limit: int) -> ChunkNumbers:
    """Chunk limits of hot keys from (key, order) alone; ``order`` is a number, unique within a key.

    Only keys with more than ``max_limit`` rows are numbered (``key_index``: a hot key spreads over range
    partitions).  A chunk's span of order numbers is spread over buckets as wide as the span itself or up to
    2^STEP_BITS times narrower, however far apart its numbers are: a span lies in at most 2^STEP_BITS + 1 buckets, and
    a bucket meets at most two spans of its level.
    """
    narrow = narrow.select(key, order)
    sizes = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_limit)
    sizes = materialize(sizes.select(key, F.ceil(F.col("n") / max_limit).cast("long").alias("n_chunks")))
    if sizes.isEmpty():
        release(sizes)
        return ChunkNumbers()
    numbered = key_index(narrow.join(sizes.select(key), key, "left_semi"), key, order, "_pos")
    firsts = numbered.where(F.col("_pos") % max_limit == 0).select(
        key, (F.col("_pos") / max_limit).cast("long").alias("chunk"), F.col(order).alias("first")
    )
    ends = numbered.groupBy(key).agg(F.max(order).alias("end"))
    upto = F.lead("first").over(Window.partitionBy(key).orderBy("first")) - 1
    spans = firsts.join(ends, key).select(key, "chunk", "first", F.coalesce(upto, "end").alias("last")).where("first <= last")
    # bits of the span's length, less one, in whole steps: 2^level <= last - first + 1 < 2^(level + STEP_BITS)
    bits = F.length(F.bin(F.floor(F.col("last") - F.col("first")).cast("long") + 1)) - 1
    spans = spans.withColumn("_level", (F.floor(bits / STEP_BITS) * STEP_BITS).cast("int"))
    low, high = (_bucket(F.col(c), F.col("_level"))["at"] for c in ("first", "last"))
    spans = spans.withColumn("_at", F.explode(F.sequence(low, high)))
    spans = materialize(spans.select(
        key, F.struct(F.col("_level").alias("level"), F.col("_at").alias("at")).alias("bucket"), "chunk", "first", "last"
    ))
    levels = materialize(spans.groupBy(key).agg(F.collect_set("bucket.level").alias("levels")))
    return ChunkNumbers(spans, levels, sizes)


def with_chunks(df: DataFrame, numbers: ChunkNumbers, key: str, order: str) -> DataFrame:
    """Adds ``chunk``: equi joins with the levels on key and the spans on (key, bucket), which Spark broadcasts when
    they are small; no sort and no table of ``df`` itself.  A row looks in one bucket of each level of its key."""
    if numbers.spans is None:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    levels = numbers.levels.select(F.col(key).alias("_l"), "levels")
    spans = numbers.spans.select(F.col(key).alias("_k"), F.col("bucket").alias("_b"), F.col("chunk").alias("_chunk"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    met = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & F.col(order).between(F.col("_first"), F.col("_last"))
    # a row outside all spans (no order number) keeps one look, in the first level
    tried = df.join(levels, F.col(key) == F.col("_l"), "left").select(*df.columns, F.posexplode_outer("levels").alias("_try", "_level"))
    tried = tried.withColumn("_at", _bucket(F.col(order), F.col("_level")))
    outside = F.col(order).isNull() | F.col("_level").isNull()
    found = tried.join(spans, met, "left").where(F.col("_chunk").isNotNull() | (outside & F.coalesce(F.col("_try") == 0, F.lit(True))))
    return found.withColumn("chunk", F.coalesce("_chunk", F.lit(0).cast("long"))).drop(
        "_try", "_level", "_at", "_k", "_b", "_chunk", "_first", "_last"
    )


def split_hot(df: DataFrame, key: str, order: str, max_limit: int) -> DataFrame:
    """Add ``chunk`` = floor(position of the row inside its key / max_limit).

    Each (key, chunk) then holds at most ``max_limit`` rows.
    """
    return with_chunks(df, chunk_numbers(df, key, order, max_limit), key, order)
