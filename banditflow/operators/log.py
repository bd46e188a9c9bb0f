"""Shaping the logged rounds: load, reshape, filters, user index and order (S, P, J1-J4, J6, A1-A4, W1, W2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.operators.ordering import global_index, key_index


# ------------------------------------------------------------------ P1 / P2 / P3 / J1
def log_shape(log: DataFrame) -> DataFrame:
    """Number of arms K and dimension d, with min/max to assert they are constant."""
    k = F.size("arms")
    d = F.size(F.element_at("arms", 1))
    return log.agg(
        F.min(k).alias("k_min"),
        F.max(k).alias("k_max"),
        F.min(d).alias("d_min"),
        F.max(d).alias("d_max"),
        F.count(F.lit(1)).alias("rounds"),
    )


def reshape_arms(flat: Column | str, k: int, d: int) -> Column:
    """Flat arm-major row (K*d values) -> K x d array of arms."""
    flat = F.col(flat) if isinstance(flat, str) else flat
    return F.array(*[F.slice(flat, a * d + 1, d) for a in range(k)])


def build_log(features: DataFrame, users: DataFrame, rewards: DataFrame, k: int, d: int, label: bool = False) -> DataFrame:
    """J1 + P3: zip the three positional inputs on row_id into one round per row."""
    r = rewards.select("row_id", F.col("r").alias("label" if label else "rewards"))
    if label:
        r = r.withColumn("label", F.element_at("label", 1))
    return (
        features.join(users, "row_id")
        .join(r, "row_id")
        .select("row_id", "user_id", reshape_arms("x", k, d).alias("arms"), "label" if label else "rewards")
    )


# ------------------------------------------------------------------ P6 / P7 / P8
def block(df: DataFrame, t1: int | Column, t2: int | Column, col: str = "round_id") -> DataFrame:
    """Rounds in [t1, t2); a range predicate Parquet min/max stats can prune."""
    c = F.col(col)
    return df.where((c >= t1) & (c < t2))


def assign_stage(df: DataFrame, iteration_length: int, control: float, col: str = "round_id") -> DataFrame:
    """block = floor(round / L); the first int(control*L) rounds of a block are 'user', the rest 'cluster'."""
    user_rounds = int(control * iteration_length)
    c = F.col(col)
    return df.withColumn("block", F.floor(c / F.lit(iteration_length)).cast("int")).withColumn(
        "stage", F.when(F.pmod(c, F.lit(iteration_length)) < user_rounds, F.lit("user")).otherwise(F.lit("cluster"))
    )


def limit_rounds(df: DataFrame, n: int | Column, col: str = "round_id") -> DataFrame:
    """Deterministic cap on rounds (round_id < n), unlike ``limit``."""
    return df.where(F.col(col) < n)


# ------------------------------------------------------------------ A1 / J2 / A4 / U3
def active(df: DataFrame, min_rounds: int) -> DataFrame:
    """A1: users with at least ``min_rounds`` rounds (partial aggregation before the shuffle)."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rounds")).where(F.col("n_rounds") >= min_rounds)


def filter_active_users(df: DataFrame, min_rounds: int) -> DataFrame:
    """Keep the rounds of frequent users (left semi join with A1)."""
    return df.join(active(df, min_rounds).select("user_id"), "user_id", "left_semi")


def renumber_rounds(df: DataFrame, order: str = "row_id", name: str = "round_id") -> DataFrame:
    """Dense 0-based round ids by ``order`` after a filter (distributed, no single-task window)."""
    return global_index(df, order, name)


def user_count(df: DataFrame) -> DataFrame:
    """Distinct users and rounds."""
    return df.agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_rounds"))


# ------------------------------------------------------------------ W1 / J4 / W2 / A2
def user_index(df: DataFrame) -> DataFrame:
    """Dense 0-based index of each distinct user in user_id order."""
    return global_index(df.select("user_id").distinct(), "user_id", "user_idx")


def with_user_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """Round -> dense user index (equi join; Spark broadcasts the index when its stats are small)."""
    return df.join(index, "user_id")


def user_seq(df: DataFrame, key: str = "user_id", order: str = "round_id") -> DataFrame:
    """0-based position of each round inside its user, in round order (skew-safe)."""
    return key_index(df, key, order, "seq")


def rounds_by_user(df: DataFrame) -> DataFrame:
    """A2 re-aimed: per-user round summary.

    The folds consume each user's rounds through a secondary sort (see
    ``operators.folds``), so no per-user list is ever collected; this gives the
    bounded facts of that grouping: count and first/last round.
    """
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rounds"), F.min("round_id").alias("first_round"), F.max("round_id").alias("last_round")
    )


def _chunked_lists(key: str, order: str, size: int):
    """Stream of (key, order) in order -> (key, chunk number inside the partition, list, piece of the key's rows)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(done):
            keys, firsts, lists = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=[key, "seq", order + "s"]
            )

        held_key, held_chunk, held, seq0 = None, None, [], 0
        for batch in batches:
            done = []
            keys, orders = np.asarray(batch.column(key)), np.asarray(batch.column(order))
            pos = np.asarray(batch.column("_pos"))
            chunk = pos // size
            cut = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (chunk[1:] != chunk[:-1])])
            for start, end in zip(cut, np.r_[cut[1:], len(keys)]):
                if held and (held_key, held_chunk) != (keys[start], chunk[start]):
                    done.append((held_key, seq0, held))
                    held = []
                if not held:
                    held_key, held_chunk, seq0 = int(keys[start]), int(chunk[start]), int(pos[start])
                held = [*held, *orders[start:end].tolist()]
            if done:
                yield flush(done)
        if held:
            yield flush([(held_key, seq0, held)])

    return run


def round_lists(df: DataFrame, size: int = 1000, key: str = "user_id", order: str = "round_id") -> DataFrame:
    """A2: (user_id, chunk, round_ids): the rounds of each user in order, ``size`` of them a row.

    (key, order) pairs go into range partitions and are sorted there, so a hot user spreads over tasks and a
    chunk is built while its rows stream by; only a chunk that meets a partition's end comes out in pieces, put
    together by a grouping of at most ``size`` numbers.
    """
    placed = key_index(df.select(key, order), key, order, "_pos")
    sorted_ = placed.repartitionByRange(key, "_pos").sortWithinPartitions(key, "_pos")
    pieces = sorted_.mapInArrow(_chunked_lists(key, order, size), f"{key} long, seq long, {order}s array<long>")
    whole = pieces.groupBy(key, F.floor(F.col("seq") / size).cast("long").alias("chunk")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", order + "s"))), lambda p: p[order + "s"])).alias(order + "s")
    )
    return whole.select(key, "chunk", order + "s")


# ------------------------------------------------------------------ J3 / J6
def replay(log: DataFrame, order: DataFrame) -> DataFrame:
    """Re-sequence rounds by a 1-based replay order: round_id := pos for row_id = M - 1."""
    o = order.select(F.col("pos").alias("round_id"), (F.col("row_id") - 1).alias("src_row"))
    src = log.withColumnRenamed("round_id", "src_row") if "round_id" in log.columns else log.withColumnRenamed("row_id", "src_row")
    return o.join(src, "src_row")


def with_cluster(rounds: DataFrame, clusters: DataFrame) -> DataFrame:
    """Attach each round's cluster label (equi join on user_id)."""
    return rounds.join(clusters.select("user_id", "cluster_id"), "user_id")
