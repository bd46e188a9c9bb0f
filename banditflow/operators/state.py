"""Ridge-regression state tables: Gram / moment aggregates, upsert, solve, cluster roll-up.

State at rest is one row per key with row-major ``A`` (d*d), ``b`` (d) and ``t``.
Array sums are generated per element (``sum(a[i])`` columns: partial
aggregation + codegen, map-side combined so a hot key costs one row per task
before the shuffle).  Wide contexts are summed in blocks instead: rows sorted by
key stream through Arrow and each run of a key adds X^T X and X^T r, one matrix
product a run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.functions import linalg as L

# Above this many elements per array, sums go through posexplode instead of generated columns.
_GENERATED_MAX = 256


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sum_arrays(df: DataFrame, key: str | Sequence[str], arrays: dict[str, int], scalars: dict[str, Column] | None = None) -> DataFrame:
    """Elementwise sums of fixed-width array columns per key (plus scalar aggregates)."""
    keys = _keys(key)
    scalars = scalars or {}
    if all(w <= _GENERATED_MAX for w in arrays.values()):
        aggs = [F.sum(F.element_at(c, i + 1)).alias(f"_s_{c}_{i}") for c, w in arrays.items() for i in range(w)]
        out = df.groupBy(*keys).agg(*aggs, *[v.alias(k) for k, v in scalars.items()])
        return out.select(
            *keys,
            *[F.array(*[F.col(f"_s_{c}_{i}") for i in range(w)]).alias(c) for c, w in arrays.items()],
            *scalars.keys(),
        )
    out = None
    for c, w in arrays.items():
        ex = df.select(*keys, F.posexplode(c).alias("_pos", "_v"))
        part = ex.groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
        # at most w values per key: the regroup is bounded by the array width
        part = part.groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"]).alias(c)
        )
        out = part if out is None else out.join(part, keys, "full_outer")
    if scalars:
        out = out.join(df.groupBy(*keys).agg(*[v.alias(k) for k, v in scalars.items()]), keys, "full_outer")
    return out


#: Rows of one key that a task takes at most; a key with more is split over tasks and its parts are added up.
KEY_ROWS = 1 << 16
#: Bytes of sums that one output batch holds.
_BATCH_BYTES = 16 << 20


def _block_sums(keys: list[str], d: int, arrays: bool):
    """Stream sorted by ``keys`` -> one row a key: (keys, A, b, t).

    ``arrays``: the input has A, b and t already (parts of a key), else x and r of single rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "A", "b", "t"]
        open_key, sums = None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*[k for k, _ in done]), key_types)]
            flat = [np.concatenate([np.asarray(s[i], dtype=np.float64).reshape(-1) for _, s in done]) for i in range(2)]
            for v, width in zip(flat, (d * d, d)):
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, width, dtype=np.int32)), pa.array(v)))
            cols.append(pa.array([s[2] for _, s in done], pa.int64()))
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key_types = [batch.column(k).type for k in keys]
            values = [batch.column(k).to_pylist() for k in keys]
            cut = [0] + [i for i in range(1, n) if any(v[i] != v[i - 1] for v in values)] + [n]
            flat = [np.asarray(batch.column(c).flatten(), dtype=np.float64) for c in (("A", "b") if arrays else ("x",))]
            last = np.asarray(batch.column("t" if arrays else "r"))
            for start, end in zip(cut, cut[1:]):
                here = tuple(v[start] for v in values)
                if arrays:
                    part = [flat[0].reshape(n, -1)[start:end].sum(axis=0), flat[1].reshape(n, -1)[start:end].sum(axis=0), int(last[start:end].sum())]
                else:
                    x = flat[0].reshape(n, d)[start:end]
                    part = [(x.T @ x).reshape(-1), x.T @ last[start:end].astype(np.float64), end - start]
                if sums is not None and here == open_key:
                    sums = [a + b for a, b in zip(sums, part)]
                    continue
                if sums is not None:
                    done.append((open_key, sums))
                open_key, sums = here, part
                if len(done) * d * d * 8 >= _BATCH_BYTES:
                    yield flush()
                    done.clear()
        if sums is not None:
            done.append((open_key, sums))
            yield flush()

    return run


def block_sums(df: DataFrame, key: str | Sequence[str], x: str, r: Column | str, d: int) -> DataFrame:
    """Per key A = sum x x^T (row-major), b = sum r x, t = count, by matrix products over the rows of a key.

    Rows travel once, d numbers each.  A key with more than ``KEY_ROWS`` rows is dealt over several tasks
    whose sums are added up; which keys those are comes from a count on the key alone.
    """
    keys = _keys(key)
    value = F.col(r) if isinstance(r, str) else r
    rows = df.select(*keys, F.col(x).alias("x"), value.cast("double").alias("r"))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > KEY_ROWS)
    hot = hot.select(*[F.col(k).alias("_h" + k) for k in keys], F.ceil(F.col("_n") / KEY_ROWS).cast("int").alias("_parts"))
    same = [F.col(k).eqNullSafe(F.col("_h" + k)) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    # at most one hot key in KEY_ROWS rows: Spark broadcasts them while they are small
    dealt = rows.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("x", "r"), F.col("_parts")).cast("int"), F.lit(0)))
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [
        T.StructField("A", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("t", T.LongType())
    ])
    part = T.StructType([*schema.fields[: len(keys)], T.StructField("_part", T.IntegerType()), *schema.fields[len(keys) :]])
    by = [*keys, "_part"]
    first = dealt.select(*by, "x", "r").repartition(*by).sortWithinPartitions(*by).mapInArrow(_block_sums(by, d, False), part)
    return first.select(*keys, "A", "b", "t").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_sums(keys, d, True), schema)


def _plus_identity(a: str, d: int) -> Column:
    """A + I without an expression an element."""
    return F.transform(a, lambda v, i: F.when(i % (d + 1) == 0, v + 1.0).otherwise(v))


def gram(df: DataFrame, key: str | Sequence[str], x: str, d: int, with_identity: bool = True) -> DataFrame:
    """A5: A = I + sum x x^T per key (upper triangle generated, mirrored)."""
    keys = _keys(key)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    if d * d <= _GENERATED_MAX:
        aggs = [F.sum(F.element_at(x, i + 1) * F.element_at(x, j + 1)).alias(f"_g{i}_{j}") for i, j in pairs]
        out = df.groupBy(*keys).agg(*aggs)
        cells = []
        for i in range(d):
            for j in range(d):
                c = F.col(f"_g{min(i, j)}_{max(i, j)}")
                cells.append(c + F.lit(1.0) if (i == j and with_identity) else c)
        return out.select(*keys, F.array(*cells).alias("A"))
    out = block_sums(df, keys, x, F.lit(0.0), d)
    return out.select(*keys, (_plus_identity("A", d) if with_identity else F.col("A")).alias("A"))


def moment(df: DataFrame, key: str | Sequence[str], x: str, r: str, d: int) -> DataFrame:
    """A6 + A7: b = sum r x and t = count per key."""
    keys = _keys(key)
    if d > _GENERATED_MAX:
        return block_sums(df, keys, x, r, d).select(*keys, "b", "t")
    aggs = [F.sum(F.col(r) * F.element_at(x, i + 1)).alias(f"_b{i}") for i in range(d)]
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("t"))
    return out.select(*keys, F.array(*[F.col(f"_b{i}") for i in range(d)]).alias("b"), "t")


def gram_moment(df: DataFrame, key: str | Sequence[str], x: str, r: str, d: int) -> DataFrame:
    """A5-A7 in one aggregation pass: A = I + sum x x^T, b = sum r x, t = count."""
    keys = _keys(key)
    if d * d > _GENERATED_MAX:
        return block_sums(df, keys, x, r, d).select(*keys, _plus_identity("A", d).alias("A"), "b", "t")
    out = deltas(df.withColumnRenamed(x, "x").withColumnRenamed(r, "reward") if (x, r) != ("x", "reward") else df, keys, d)
    diag = {i * d + i for i in range(d)}
    a = F.array(*[F.element_at("dA", i + 1) + F.lit(1.0) if i in diag else F.element_at("dA", i + 1) for i in range(d * d)])
    return out.select(*keys, a.alias("A"), F.col("db").alias("b"), F.col("dt").alias("t"))


def deltas(decisions: DataFrame, key: str | Sequence[str], d: int) -> DataFrame:
    """A10: per-key sums of the emitted updates: dA = sum x x^T, db = sum r x, dt = count."""
    keys = _keys(key)
    if d * d > _GENERATED_MAX:
        return block_sums(decisions, keys, "x", "reward", d).toDF(*keys, "dA", "db", "dt")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = [F.sum(F.element_at("x", i + 1) * F.element_at("x", j + 1)).alias(f"_g{i}_{j}") for i, j in pairs]
    aggs += [F.sum(F.col("reward") * F.element_at("x", i + 1)).alias(f"_b{i}") for i in range(d)]
    out = decisions.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("dt"))
    return out.select(
        *keys,
        F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)]).alias("dA"),
        F.array(*[F.col(f"_b{i}") for i in range(d)]).alias("db"),
        "dt",
    )


def init_state(users: DataFrame, d: int) -> DataFrame:
    """(I, 0, 0) for every user."""
    return users.select("user_id").distinct().select(
        "user_id", L.identity(d).alias("A"), L.zeros(d).alias("b"), F.lit(0).cast("long").alias("t")
    )


def merge_state(state: DataFrame, delta: DataFrame, d: int, key: str = "user_id") -> DataFrame:
    """Upsert deltas (dA, db, dt) into (A, b, t); missing sides count as (I, 0, 0) / no change."""
    s = state.select(key, "A", "b", "t")
    j = s.join(delta.select(key, "dA", "db", "dt"), key, "full_outer")
    a = F.coalesce(F.col("A"), L.identity(d))
    b = F.coalesce(F.col("b"), L.zeros(d))
    t = F.coalesce(F.col("t"), F.lit(0).cast("long"))
    return j.select(
        key,
        F.when(F.col("dA").isNull(), a).otherwise(L.add(a, "dA")).alias("A"),
        F.when(F.col("db").isNull(), b).otherwise(L.add(b, "db")).alias("b"),
        (t + F.coalesce(F.col("dt"), F.lit(0).cast("long"))).alias("t"),
    )


# ------------------------------------------------------------------ M7 grouped ridge
def _solver(key_cols: list[str], d: int, a_col: str, b_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            A = np.asarray(batch.column(a_col).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, d, d)
            b = np.asarray(batch.column(b_col).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, d, 1)
            theta = np.linalg.solve(A, b).reshape(n * d)
            offsets = np.arange(0, n * d + 1, d, dtype=np.int32)
            cols = [batch.column(c) for c in key_cols]
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(theta, type=pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=key_cols + [out_col])

    return run


def grouped_ridge(state: DataFrame, d: int, key: str | Sequence[str] = "user_id", a_col: str = "A", b_col: str = "b", out_col: str = "theta", keep: Sequence[str] = ()) -> DataFrame:
    """M7: theta = A^-1 b for every row, one batched ``np.linalg.solve`` per Arrow batch.

    Narrow (no shuffle): keeps the input partitioning, so a later join on the
    key reuses it.
    """
    keys = _keys(key) + [c for c in keep if c not in _keys(key)]
    schema = T.StructType(
        [state.schema[c] for c in keys] + [T.StructField(out_col, T.ArrayType(T.DoubleType(), True), True)]
    )
    return state.select(*keys, a_col, b_col).mapInArrow(_solver(keys, d, a_col, b_col, out_col), schema)


# ------------------------------------------------------------------ A8 / A9
def rollup_clusters(state: DataFrame, clusters: DataFrame, d: int) -> DataFrame:
    """Per cluster A = I + sum(A_u - I), b = sum b_u, t = sum t_u, members = count."""
    j = state.join(clusters.select("user_id", "cluster_id"), "user_id")
    j = j.withColumn("_dA", L.sub("A", L.identity(d)))
    out = sum_arrays(j, "cluster_id", {"_dA": d * d, "b": d}, {"t": F.sum("t"), "members": F.count(F.lit(1))})
    return out.select("cluster_id", L.add("_dA", L.identity(d)).alias("A"), "b", F.col("t").cast("long").alias("t"), "members")


def cluster_mean_t(cluster_state: DataFrame, block_counts: DataFrame | None, mean_over: str = "interactions") -> DataFrame:
    """Cluster experience sum(t) / rounds of the cluster in the block (as written),
    or / members (``mean_over='members'``).  Clusters without rounds get NULL."""
    if mean_over == "members":
        return cluster_state.withColumn("mean_t", F.col("t") / F.col("members"))
    j = cluster_state.join(block_counts.select("cluster_id", "block_rounds"), "cluster_id", "left")
    return j.withColumn("mean_t", F.col("t") / F.col("block_rounds"))


def cluster_block_counts(rounds: DataFrame, clusters: DataFrame) -> DataFrame:
    """A3: rounds per cluster in the block; counted per user first, so one row a user meets the labels."""
    per_user = rounds.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(clusters.select("user_id", "cluster_id"), "user_id").groupBy("cluster_id").agg(
        F.sum("n").alias("block_rounds")
    )
