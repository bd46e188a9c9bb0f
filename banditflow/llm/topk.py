"""Exact top-k by inner product: a Voronoi kNN join.

Pivots (a bounded, hash-chosen sample) cut the data into cells.  A cell's summary is its size and the
greatest distance r of a member from its pivot p; then for a query q every member's score lies in
q.p - |q| r to q.p + |q| r.  The summaries alone give each query a score that at least k
members surely reach; a cell whose upper bound is below it cannot matter.  Queries are grouped by
their own nearest pivots, a group is sent to every cell that matters for one of its queries, and there
the queries that need the cell are scored against its members.  Cells are dealt in blocks of a
bounded number of members, so a cell of one often repeated vector is many tasks' work; the k best of the
blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from banditflow.session import materialize

PIVOTS, BLOCK = 256, 8192


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x) of every component as 64-bit integers, for usable vectors.

    A vector that is null, or has a null, NaN or infinite component, takes no part; nor does a row
    without an id.
    """
    x = F.col(embedding).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros, which add nothing to a score."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def _assign(pivots: np.ndarray, width: int):  # noqa: ANN202
    """Nearest pivot of each row, and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots * pivots).sum(1) / 2
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), width)
                cell = (x @ pivots.T - half).argmax(1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"]
                )

    return run


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of every query.

    ``data`` and ``queries``: (id, v) with integer components (``quantised``), whose products must stay
    below 2**53.  A query meets every row of another id; ties go to the smaller id; with fewer
    candidates than ``k`` all are given.  Vectors of unequal length are filled up with zeros.  Rows
    that share an id are candidates each; repeats of a query row are one query, and of rows that share
    a query id but not a vector the greatest vector is the query.
    """
    spark = data.sparkSession
    data = materialize(data.select("id", "v"))
    queries = queries.groupBy("id").agg(F.max("v").alias("v"))
    width = data.agg(F.max(F.size("v"))).first()[0]
    width = max(width or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return spark.createDataFrame([], schema)
    picked = data.orderBy(F.xxhash64("id", "v")).limit(pivots).select("v").collect()
    p = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        p[i, : len(r.v)] = r.v
    p = np.unique(p, axis=0)
    if not len(p):
        return spark.createDataFrame([], schema)
    kind = "id long, v array<long>, cell long, far double"
    cells = materialize(data.mapInArrow(_assign(p, width), kind))
    # one row a cell: at most ``pivots`` rows
    summary = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()
    own = cells.groupBy("id").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    asked = queries.join(own, "id", "left").select("id", "v", F.coalesce("own", F.lit(1)).alias("own"))
    cell_no = np.array([s["cell"] for s in summary])
    size, r = np.array([s["n"] for s in summary]), np.array([s["r"] for s in summary])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v"), width)
            middle, slack = q @ p[cell_no].T, np.sqrt((q * q).sum(1))[:, None] * r + 1e-6
            low, high = middle - slack, middle + slack
            order = np.argsort(-low, 1)
            # rows of the query's own id may be among those a cell promises
            sure = np.cumsum(size[order], 1) >= k + b.column("own").to_numpy()[:, None]
            at = np.where(sure.any(1), sure.argmax(1), -1)
            floor = np.where(at >= 0, np.take_along_axis(low, order, 1)[np.arange(len(q)), at], -np.inf)
            row, cell = np.nonzero(high >= floor[:, None])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(cell_no[cell])],
                names=["id", "v", "cell"],
            )

    sent = asked.mapInArrow(route, "id long, v array<long>, cell long")
    # blocks of a cell: members dealt by hash, queries sent to each block
    blocks = {int(c): int(-(-n // block)) for c, n in zip(cell_no, size)}
    count = F.element_at(F.create_map(*[F.lit(x) for c in blocks.items() for x in c]), F.col("cell").cast("int"))
    members = cells.select("cell", F.pmod(F.xxhash64("id"), count).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    sent = sent.select("cell", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v")
    dealt = members.unionAll(sent).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks", "id")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, None, None  # the open block's members

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "part", "asks")], 1)
            edge = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            all_ids, v = b.column("id").to_numpy(), _matrix(b.column("v"), width)
            for lo, hi in zip(edge, edge[1:]):
                block_key = tuple(at[lo, :2])
                if block_key != key:
                    key, ids, rows = block_key, np.empty(0, np.int64), np.empty((0, width))
                if not at[lo, 2]:
                    ids, rows = np.concatenate((ids, all_ids[lo:hi])), np.concatenate((rows, v[lo:hi]))
                    continue
                for x in range(lo, hi, 256):
                    y = min(hi, x + 256)
                    yield _best(all_ids[x:y], v[x:y], ids, rows, k)

    found = dealt.mapInArrow(solve, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    score = q @ rows.T  # exact: sums of products of integers below 2**53
    score[q_ids[:, None] == ids] = -np.inf
    if len(ids) > k:
        # everything that ties with the k-th best stays until ids are compared
        kth = np.partition(score, len(ids) - k, 1)[:, len(ids) - k]
        row, col = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
    else:
        row, col = np.nonzero(np.isfinite(score))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids[row]), pa.array(ids[col]), pa.array(score[row, col].astype(np.int64))],
        names=["query_id", "vec_id", "score"],
    )
