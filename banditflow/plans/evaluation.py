"""R4 + R5: load the log, replay the per-user policy, compare with the random policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.operators import evaluate as E
from banditflow.operators.folds import UserUCB, run_fold
from banditflow.sources import fixtures as fx


def flagship_curve(spark: SparkSession, sf_dir: str, alpha: float = 0.03, seed: int = 0) -> DataFrame:
    """How much better than random is a per-user UCB policy on this log, round by round?"""
    log = fx.bandit_log(spark, sf_dir)
    policy = run_fold(log, None, UserUCB(fx.D, fx.K, alpha)).decisions
    curve = E.normalised_curve(policy, E.random_policy(log, seed))
    return curve.select("round_id", "cum_reward", "cum_random", F.round("ratio", 6).alias("ratio"))
