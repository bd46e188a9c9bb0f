"""Policy evaluation: random baseline (F7), cumulative curves (W3, W4), totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.functions import linalg as L
from banditflow.functions.draws import uniform_int
from banditflow.operators.ordering import running_sum


def random_arm(round_id: Column, n_arms: int | Column, seed: int = 0) -> Column:
    """Seeded uniform arm per round (``functions.draws``; the same on any engine)."""
    return uniform_int(round_id, n_arms, seed)


def random_policy(log: DataFrame, seed: int = 0, reward: str = "matrix") -> DataFrame:
    """one seeded random arm per round, its reward, and the exact expectation mean(rewards)."""
    choice = random_arm(F.col("round_id"), F.size("arms"), seed)
    df = log.withColumn("choice", choice)
    if reward == "label":
        arm_hit = F.transform("arms", lambda x: L.match_reward(x, F.col("label")))
        df = df.withColumn("reward", L.match_reward(L.pick("arms", "choice"), "label"))
        expected = F.aggregate(arm_hit, F.lit(0.0), lambda a, v: a + v) / F.size("arms")
    else:
        df = df.withColumn("reward", L.pick_reward("rewards", "choice"))
        expected = F.aggregate("rewards", F.lit(0.0), lambda a, v: a + v) / F.size("rewards")
    return df.select("round_id", "user_id", "choice", "reward", expected.alias("expected_reward"))


def normalised_curve(policy: DataFrame, random: DataFrame, block: int = 1 << 20) -> DataFrame:
    """W3 + W4: cum(policy reward) / cum(random reward) per round, in round order.

    Both inputs carry (round_id, reward) with dense round ids.  The running sums
    are two-level (``running_sum``), never a single-task window.  0/0 and x/0 are
    NULL, as the reference masks them.
    """
    joined = policy.select("round_id", F.col("reward").alias("r_policy")).join(
        random.select("round_id", F.col("reward").alias("r_random")), "round_id"
    )
    cum = running_sum(joined, "round_id", ["r_policy", "r_random"], block=block)
    return cum.select(
        "round_id",
        F.col("r_policy_cum").alias("cum_reward"),
        F.col("r_random_cum").alias("cum_random"),
        F.when(F.col("r_random_cum") != 0, F.col("r_policy_cum") / F.col("r_random_cum")).alias("ratio"),
    )


def finite_sum(curve: DataFrame, col: str = "ratio") -> DataFrame:
    """Sum of the finite values (NULL, NaN and +-inf skipped)."""
    c = F.col(col)
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return curve.agg(F.sum(F.when(ok, c)).alias("normalised_total"))


def policy_totals(decisions: DataFrame) -> DataFrame:
    """Total reward and rounds played per (stage, block)."""
    return decisions.groupBy("stage", "block").agg(
        F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("rounds")
    )
