"""Global order operators that never funnel a table through one task.

A window with ``orderBy`` and no ``partitionBy`` runs in a single task; these
helpers give the same results in two levels instead:

* ``global_index``: dense 0-based position by a unique key.  Range-partition
  by the key, number rows inside each partition with a streaming counter, and
  add the row count of all earlier partitions (one small row per partition,
  broadcast; its size is bounded by the partition count, not by the data).
* ``running_sum``: cumulative sums ordered by a dense integer key, computed per
  key range block and offset by the totals of earlier blocks (one small row per
  block).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.session import materialize

_PID = "_bf_pid"
_LOCAL = "_bf_local"


def _number_within_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = 0
    for pdf in batches:
        n = len(pdf)
        pdf[_LOCAL] = pd.RangeIndex(seen, seen + n).to_numpy(dtype="int64")
        seen += n
        yield pdf


def global_index(df: DataFrame, order: Sequence[str] | str, name: str = "idx") -> DataFrame:
    """Add ``name`` = position (0-based) of each row in ``order``.

    ``order`` must be unique per row (ties would get an arbitrary order).
    """
    cols = [order] if isinstance(order, str) else list(order)
    parted = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn(_PID, F.spark_partition_id())
    )
    schema = T.StructType(parted.schema.fields + [T.StructField(_LOCAL, T.LongType(), False)])
    # Number inside each range partition, then pin the result: the range bounds
    # are sampled, so counts and numbers must come from the same run.
    numbered = materialize(parted.mapInPandas(_number_within_partition, schema))
    counts = numbered.groupBy(_PID).agg(F.count(F.lit(1)).alias("_bf_n"))
    # One row per partition: a single-task window here is bounded by the partition count.
    offsets = counts.select(
        _PID,
        F.coalesce(
            F.sum("_bf_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_bf_off"),
    )
    return (
        numbered.join(F.broadcast(offsets), _PID)
        .withColumn(name, F.col("_bf_off") + F.col(_LOCAL))
        .drop(_PID, _LOCAL, "_bf_off")
    )


def running_sum(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    block: int = 1 << 20,
    suffix: str = "_cum",
) -> DataFrame:
    """Cumulative sums of ``values`` ordered by the dense integer key ``order``.

    Rows are grouped into key ranges of ``block`` keys; each range is one window
    partition (bounded by ``block`` rows), and the totals of earlier ranges --
    one row per range -- are added back by a join.
    """
    blk = F.floor(F.col(order) / F.lit(block)).cast("long")
    with_blk = materialize(df.withColumn("_bf_blk", blk))  # read twice
    w = Window.partitionBy("_bf_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = with_blk.select("*", *[F.sum(v).over(w).alias(f"_bf_loc_{v}") for v in values])
    totals = with_blk.groupBy("_bf_blk").agg(*[F.sum(v).alias(f"_bf_tot_{v}") for v in values])
    wo = Window.orderBy("_bf_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bf_blk",
        *[F.coalesce(F.sum(f"_bf_tot_{v}").over(wo), F.lit(0)).alias(f"_bf_off_{v}") for v in values],
    )
    out = local.join(offsets, "_bf_blk")
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_bf_loc_{v}") + F.col(f"_bf_off_{v}"))
    return out.drop("_bf_blk", *[f"_bf_loc_{v}" for v in values], *[f"_bf_off_{v}" for v in values])


def _number_per_key(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key = None
        seen = 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            kv = pdf[keys].to_numpy()
            change = np.ones(n, dtype=bool)
            change[1:] = (kv[1:] != kv[:-1]).any(axis=1)
            pos = np.arange(n, dtype=np.int64)
            local = pos - np.maximum.accumulate(np.where(change, pos, 0))
            if last_key is not None and tuple(kv[0]) == last_key:
                local[np.cumsum(change) == 1] += seen
            seen = int(local[-1]) + 1
            last_key = tuple(kv[-1])
            pdf[_LOCAL] = local
            yield pdf

    return run


def key_index(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, name: str = "seq") -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its key, by ``order``.

    Same result as ``row_number() over (partition by keys order by order) - 1``
    but a hot key is spread over several range partitions instead of one window
    task: rows are range-partitioned on (keys, order), numbered per key inside
    each partition, and offset by the rows of the same key in earlier partitions
    (a small (partition, key) count table).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    parted = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(_PID, F.spark_partition_id())
    )
    schema = T.StructType(parted.schema.fields + [T.StructField(_LOCAL, T.LongType(), False)])
    numbered = materialize(parted.mapInPandas(_number_per_key(keys), schema))
    counts = numbered.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("_bf_n"))
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # only a partition's first key can have rows in an earlier one: at most one offset a partition
    offsets = counts.select(_PID, *keys, F.sum("_bf_n").over(w).alias("_bf_off")).where("_bf_off > 0")
    return (
        numbered.join(F.broadcast(offsets), [_PID, *keys], "left")
        .withColumn(name, F.coalesce("_bf_off", F.lit(0)) + F.col(_LOCAL))
        .drop(_PID, _LOCAL, "_bf_off")
    )
