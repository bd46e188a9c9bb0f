"""The physical plans the design relies on."""

from banditflow.operators.folds import UserUCB, sequential_fold
from banditflow.operators.log import block
from banditflow.sources import fixtures as fx
from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_is_one_exchange_then_sort_and_arrow_map(spark):
    log = fx.bandit_log(spark, SF01)
    plan = _plan(sequential_fold(block(log, 2500, 5000), None, UserUCB(fx.D, fx.K, 0.03)))
    assert plan.count("Exchange hashpartitioning(user_id") == 1
    assert "MapInArrow" in plan and "Sort [user_id" in plan
    # the block's round range is pushed into the Parquet scan (row groups outside are skipped)
    assert "GreaterThanOrEqual(event_id,2500)" in plan and "LessThan(event_id,5000)" in plan
    # the embeddings dimension is joined without shuffling the rounds
    assert "SortMergeJoin" not in plan


def test_fixture_scan_is_pruned(spark):
    plan = _plan(fx.bandit_log(spark, SF01))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan or "struct<event_id:bigint,user_id:bigint>" in plan
