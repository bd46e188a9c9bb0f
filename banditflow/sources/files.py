"""Headerless CSV inputs of the logged rounds and Parquet sinks of the curves.

The logged data comes as separate positional files: candidate vectors (K*d
columns, arm-major), the user column, the reward matrix (K columns) or the
logged label (1 column), and a 1-based replay order.  Files carry no key, so
each reader adds ``row_id`` = the line position over all files, by path.  One narrow
pass (no column is parsed) counts the rows of every split; the rows themselves are read in place and get
the offset of their split plus their place in it: no sort and no exchange of wide rows, and large
files still split across tasks.  Production inputs should rather be Parquet with an explicit ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.operators.log import build_log, filter_active_users, limit_rounds, renumber_rounds
from banditflow.session import materialize_counted

#: Up to so many splits (a row of about 200 bytes each) are broadcast to the rows.
BROADCAST_SPLITS = 500_000


def _read_positional(spark: SparkSession, path: str, n_cols: int, typ: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", typ, True) for i in range(n_cols)])
    df = spark.read.schema(schema).option("header", "false").option("mode", "FAILFAST").csv(path)
    # a row's number inside its task; a task reads whole splits one after the other, both times the same ones
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    splits = placed.groupBy("_file", "_start").agg(F.min("_pos").alias("_base"), F.count(F.lit(1)).alias("_n"))
    # one row a split: the running sum over them is as small as the number of splits
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets, n = materialize_counted(splits.withColumn("_off", F.coalesce(before, F.lit(0))))
    joined = placed.join(F.broadcast(offsets) if n <= BROADCAST_SPLITS else offsets, ["_file", "_start"])
    at = F.col("_pos") - F.col("_base")
    row_id = F.when((at >= 0) & (at < F.col("_n")), F.col("_off") + at).otherwise(
        F.raise_error(F.lit("the splits of a CSV input changed between two passes")).cast("long")
    )
    return joined.withColumn("row_id", row_id).drop("_file", "_start", "_pos", "_base", "_n", "_off")


def read_features(spark: SparkSession, path: str, k: int, d: int) -> DataFrame:
    """row_id, x array<double> (K*d values, arm-major)."""
    df = _read_positional(spark, path, k * d, T.DoubleType())
    return df.select("row_id", F.array(*[F.col(f"c{i}") for i in range(k * d)]).alias("x"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """row_id, user_id."""
    return _read_positional(spark, path, 1, T.LongType()).select("row_id", F.col("c0").alias("user_id"))


def read_rewards(spark: SparkSession, path: str, k: int, kind: str = "matrix") -> DataFrame:
    """S3: row_id, r array<double> (K rewards, or the one logged label)."""
    n = 1 if kind == "label" else k
    df = _read_positional(spark, path, n, T.DoubleType())
    return df.select("row_id", F.array(*[F.col(f"c{i}") for i in range(n)]).alias("r"))


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """Pos (0-based replay position), row_id (1-based row number into the log)."""
    df = _read_positional(spark, path, 1, T.LongType())
    return df.select(F.col("row_id").alias("pos"), F.col("c0").alias("row_id"))


def _n_columns(spark: SparkSession, path: str) -> int:
    """Columns of a headerless CSV input, from its first line."""
    return len(spark.read.option("header", "false").csv(path).columns)


def load_log(
    spark: SparkSession,
    features_path: str,
    users_path: str,
    rewards_path: str,
    label: bool = False,
    min_rounds: int = 0,
    max_rounds: int | None = None,
) -> DataFrame:
    """The load job: a log ready for the replays (round_id 0..n-1, user_id, arms, rewards or label).

    K is the number of reward columns (with ``label``: of feature columns, d being 1) and d the feature
    columns divided by K.  Rounds of users with fewer than ``min_rounds`` go, the rest is renumbered in
    file order, and of those the first ``max_rounds`` stay.
    """
    width = _n_columns(spark, features_path)
    k = width if label else _n_columns(spark, rewards_path)
    if not k or width % k:
        raise ValueError(f"{width} feature columns are no multiple of {k} arms")
    d = width // k
    rewards = read_rewards(spark, rewards_path, k, "label" if label else "matrix")
    log = build_log(read_features(spark, features_path, k, d), read_users(spark, users_path), rewards, k, d, label)
    if min_rounds > 1:
        log = filter_active_users(log, min_rounds)
    log = renumber_rounds(log, "row_id", "round_id").drop("row_id")
    return log if max_rounds is None else limit_rounds(log, max_rounds)


def write_curve(curve: DataFrame, path: str) -> None:
    """The normalised reward curve (round_id, cum_reward, cum_random, ratio)."""
    curve.write.mode("overwrite").parquet(path)


def write_clusters(cluster_counts: DataFrame, path: str) -> None:
    """The cluster-count curve (block, from_round, to_round, n_clusters, n_edges)."""
    cluster_counts.write.mode("overwrite").parquet(path)
