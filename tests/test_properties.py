import numpy as np
from pyspark.sql import functions as F

from banditflow.operators.folds import UserUCB, run_fold
from banditflow.operators.skew import split_hot
from banditflow.sources import fixtures as fx
from conftest import SF001


def test_fold_ignores_input_order(spark):
    log = fx.bandit_log(spark, SF001)
    a = {(r.round_id, r.choice) for r in run_fold(log, None, UserUCB(fx.D, fx.K, 0.03)).decisions.collect()}
    shuffled = log.repartition(7, F.rand(11)).sortWithinPartitions(F.rand(12))
    b = {(r.round_id, r.choice) for r in run_fold(shuffled, None, UserUCB(fx.D, fx.K, 0.03)).decisions.collect()}
    assert a == b


def test_state_symmetric_with_trace_identity(spark):
    log = fx.bandit_log(spark, SF001)
    res = run_fold(log, None, UserUCB(fx.D, fx.K, 0.03))
    sq = res.decisions.groupBy("user_id").agg(
        F.sum(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)).alias("sq"), F.count(F.lit(1)).alias("n")
    )
    rows = {r.user_id: (r.sq, r.n) for r in sq.collect()}
    for r in res.state.collect():
        A = np.asarray(r.A).reshape(fx.D, fx.D)
        assert np.allclose(A, A.T)
        assert np.isclose(np.trace(A), fx.D + rows[r.user_id][0])
        assert r.t == rows[r.user_id][1]


def test_split_with_unbounded_limit_is_no_split(spark):
    log = fx.bandit_log(spark, SF001).select("round_id", "user_id")
    out = split_hot(log, "user_id", "round_id", 10**12)
    assert out.where("chunk <> 0").count() == 0
    chunks = split_hot(log, "user_id", "round_id", 7)
    biggest = chunks.groupBy("user_id", "chunk").count().agg(F.max("count")).first()[0]
    assert biggest == 7
