"""banditflow: offline replay of clustered contextual bandits on Spark DataFrames.

Typical use::

    from banditflow import ReplayConfig, build_log, read_features, read_users, read_rewards
    from banditflow import filter_active_users, renumber_rounds, two_stage_replay
    from banditflow import normalised_curve, random_policy

    raw = build_log(read_features(spark, x_csv, k, d), read_users(spark, u_csv), read_rewards(spark, r_csv, k), k, d)
    log = renumber_rounds(filter_active_users(raw, 50))          # dense round_id after the user filter
    result = two_stage_replay(log, ReplayConfig(iteration_length=80000), k, d)
    curve = normalised_curve(result.decisions, random_policy(log))
"""

from banditflow.config import ReplayConfig
from banditflow.operators.evaluate import finite_sum, normalised_curve, policy_totals, random_policy
from banditflow.operators.folds import BufferedAgent, ClusterSequentialUCB, ClusterUCB, UserUCB, run_fold
from banditflow.operators.graph import complement_components, connected_components, prune_edges, similar_users
from banditflow.operators.log import build_log, filter_active_users, renumber_rounds, replay
from banditflow.operators.state import grouped_ridge, merge_state, rollup_clusters
from banditflow.plans.gossip import gossip_replay
from banditflow.plans.lazy import lazy_replay
from banditflow.plans.two_stage import two_stage_replay
from banditflow.sources.files import read_features, read_order, read_rewards, read_users, write_clusters, write_curve

__all__ = [
    "ReplayConfig",
    "build_log", "filter_active_users", "renumber_rounds", "replay",
    "read_features", "read_users", "read_rewards", "read_order", "write_curve", "write_clusters",
    "run_fold", "UserUCB", "ClusterUCB", "ClusterSequentialUCB", "BufferedAgent",
    "grouped_ridge", "merge_state", "rollup_clusters",
    "similar_users", "prune_edges", "connected_components", "complement_components",
    "random_policy", "normalised_curve", "finite_sum", "policy_totals",
    "two_stage_replay", "lazy_replay", "gossip_replay",
]
