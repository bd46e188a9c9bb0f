"""Bandit logs derived from the driver's test tables (see FIXTURES.md).

Every fixture is built by integer arithmetic and equi joins from ``events`` and
``embeddings``, so the DuckDB oracles in ``banditflow.oracles`` rebuild the same
rows.  All work is declarative: the per-arm vector lookups are equi joins with
the embeddings dimension (Spark broadcasts it only when its size statistics are
under the broadcast threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.operators.ordering import global_index
from banditflow.sources.testdata import read_table

# Fixed values of the fixture rule (FIXTURES.md section 3):
#   K = 5 arms, d = 4 features, arm a uses embedding vec_id = (event_id*7 + a*101) % (rows of embeddings),
#   feature i = sum of the 16 components 16i+1 .. 16i+16 of that embedding, in order; reward of an arm = 1
#   when its component (user_id % 4) exceeds 0.5; label log: label = (event_id*7 + (user_id%5)*101) %
#   (rows of embeddings); cold users: user_id % 5 = 0 keep rounds with round_id >= N*3/4.
K = 5
D = 4
ARM_STRIDE = 7
ARM_OFFSET = 101
QUARTER = 16
REWARD_CUT = 0.5


def _n_vecs(spark: SparkSession, sf_dir: str) -> Column:
    return read_table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def _vec_id(a: int) -> Column:
    return (F.col("event_id") * ARM_STRIDE + a * ARM_OFFSET) % F.col("_n_vecs")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return ev.withColumn("_n_vecs", _n_vecs(spark, sf_dir))


def _feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole embedding as D features, one for each quarter."""
    emb = read_table(spark, sf_dir, "embeddings")
    quarters = [
        F.aggregate(F.slice("embedding", i * QUARTER + 1, QUARTER), F.lit(0.0), lambda s, v: s + v.cast("double"))
        for i in range(D)
    ]
    return emb.select("vec_id", F.array(*quarters).alias("vec"))


def arm_rewards(arms: Column, user_id: Column) -> Column:
    """Reward of each arm: 1 when the arm's component ``user_id % 4`` > 0.5."""
    pos = (F.pmod(user_id, F.lit(D)) + 1).cast("int")
    return F.transform(arms, lambda x: F.when(F.element_at(x, pos) > REWARD_CUT, 1.0).otherwise(0.0))


def bandit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_id, user_id, arms array<array<double>> (K x d), rewards array<double> (K)."""
    vecs = _feature_vectors(spark, sf_dir)
    df = _events(spark, sf_dir)
    for a in range(K):
        # the same dimension plan each time, so one broadcast (or shuffle) of it is reused
        v = vecs.alias(f"v{a}")
        df = df.join(v, _vec_id(a) == F.col(f"v{a}.vec_id")).select(*df.columns, F.col(f"v{a}.vec").alias(f"_x{a}"))
    arms = F.array(*[F.col(f"_x{a}") for a in range(K)])
    return df.select(
        F.col("event_id").alias("round_id"),
        "user_id",
        arms.alias("arms"),
        arm_rewards(arms, F.col("user_id")).alias("rewards"),
    )


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_id, user_id, arms (K x 1, the vec_id), label: the rewarded arm's value."""
    ev = _events(spark, sf_dir)
    arms = F.array(*[F.array(_vec_id(a).cast("double")) for a in range(K)])
    label = ((F.col("event_id") * ARM_STRIDE + F.pmod("user_id", F.lit(K)) * ARM_OFFSET) % F.col("_n_vecs")).cast("double")
    return ev.select(F.col("event_id").alias("round_id"), "user_id", arms.alias("arms"), label.alias("label"))


def cold_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bandit_log where users with user_id % 5 = 0 join late (last quarter only).

    Rounds are renumbered 0..n-1 in round_id order with the distributed
    ``global_index`` (no single-task window).
    """
    log = bandit_log(spark, sf_dir)
    n_rounds = read_table(spark, sf_dir, "events").select(F.count(F.lit(1))).scalar()
    keep = (F.pmod("user_id", F.lit(5)) != 0) | (F.col("round_id") >= F.floor(n_rounds * 3 / 4))
    kept = log.where(keep).withColumnRenamed("round_id", "orig_round")
    return global_index(kept, "orig_round", "round_id").select("round_id", "user_id", "arms", "rewards")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x: the arms flattened arm-major (K*d values), as in a wide CSV row."""
    return bandit_log(spark, sf_dir).select(F.col("round_id").alias("row_id"), F.flatten("arms").alias("x"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandit_log(spark, sf_dir).select(F.col("round_id").alias("row_id"), "user_id")


def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandit_log(spark, sf_dir).select(F.col("round_id").alias("row_id"), F.col("rewards").alias("r"))


def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, row_id: a permutation of 1-based rows, row_id = 1 + (pos*7) % N."""
    ev = read_table(spark, sf_dir, "events").select("event_id")
    n_rounds = ev.select(F.count(F.lit(1))).scalar()
    return ev.select(
        F.col("event_id").alias("pos"),
        (F.lit(1) + F.pmod(F.col("event_id") * ARM_STRIDE, n_rounds)).cast("long").alias("row_id"),
    )
