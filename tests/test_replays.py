from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.plans.two_stage import two_stage_replay
from banditflow.sources import fixtures as fx
from conftest import SF001, SF01


def _summary(r):
    used = {
        (row.block, row.stage): row.used
        for row in r.decisions.groupBy("block", "stage").agg(F.sum(F.col("cluster_used").cast("int")).alias("used")).collect()
    }
    counts = sorted((row.block, row.n_clusters, row.n_edges) for row in r.cluster_counts.collect())
    return r.decisions.agg(F.sum("reward")).first()[0], used, counts


def test_two_stage_recorded_runs(spark):
    """Recorded runs of this library at sf0.01: L = 5000, control 0.5, alpha2 = 0.7."""
    log = fx.bandit_log(spark, SF01)
    total, used, counts = _summary(two_stage_replay(log, ReplayConfig(iteration_length=5000, mean_over="members", list_edges=True), fx.K, fx.D))
    assert total == 5168
    assert [c[1:] for c in counts] == [(1, 2812), (4, 2461)]
    assert used[(0, "cluster")] == 281 and used[(1, "cluster")] == 505
    total, used, counts = _summary(
        two_stage_replay(log, ReplayConfig(iteration_length=5000, mean_over="interactions", list_edges=True), fx.K, fx.D)
    )
    assert total == 5235
    assert [c[1:] for c in counts] == [(1, 2812), (4, 2461)]
    assert used[(0, "cluster")] == 0 and used[(1, "cluster")] == 0


def test_cluster_stage_with_negative_mean_is_user_stage(spark):
    """F2 never uses the cluster model when t_user > mean t always holds."""
    from banditflow.operators.folds import ClusterUCB, UserUCB, run_fold
    from banditflow.functions import linalg as L

    log = fx.bandit_log(spark, SF001)
    users = log.select("user_id").distinct()
    st = users.select("user_id", L.identity(fx.D).alias("cA"), L.zeros(fx.D).alias("cb"), F.lit(-1.0).alias("ct"))
    a = run_fold(log, st, ClusterUCB(fx.D, fx.K, 0.03), track_used=True).decisions
    b = run_fold(log, None, UserUCB(fx.D, fx.K, 0.03)).decisions
    assert a.where("cluster_used").count() == 0
    assert {(r.round_id, r.choice) for r in a.collect()} == {(r.round_id, r.choice) for r in b.collect()}


def test_cold_log_size(spark):
    assert fx.cold_log(spark, SF01).count() == 8490


def test_two_stage_on_cold_log(spark):
    """Recorded runs on cold_log (L = 2000): late users meet existing cluster models."""
    log = fx.cold_log(spark, SF01)
    for mode, total, uses in (("interactions", 4362, [0, 0, 0, 53, 0]), ("members", 4296, [69, 86, 36, 224, 0])):
        r = two_stage_replay(log, ReplayConfig(iteration_length=2000, mean_over=mode), fx.K, fx.D)
        assert r.decisions.agg(F.sum("reward")).first()[0] == total
        got = dict(
            r.decisions.where(F.col("stage") == "cluster")
            .groupBy("block").agg(F.sum(F.col("cluster_used").cast("int")).alias("u")).collect()
        )
        assert [got.get(b, 0) for b in range(5)] == uses


def test_two_stage_four_iterations(spark):
    """Recorded run at sf0.01: L = 2500, members mode, four iterations."""
    log = fx.bandit_log(spark, SF01)
    total, used, counts = _summary(two_stage_replay(log, ReplayConfig(iteration_length=2500, mean_over="members", list_edges=True), fx.K, fx.D))
    assert total == 5126
    assert [c[1:] for c in counts] == [(1, 6904), (1, 2505), (4, 2439), (4, 2426)]
    assert [used[(b, "cluster")] for b in range(4)] == [224, 371, 387, 432]
