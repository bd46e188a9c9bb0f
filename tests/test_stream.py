"""The stream against the batch replay: any arrival order, rounds delivered twice, a restart in the middle of a block."""

import pytest
from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.operators.folds import UserUCB, run_fold
from banditflow.plans import two_stage as TS
from banditflow.sources import fixtures as fx
from banditflow.streaming import replay_stream as RS
from conftest import SF001

CFG = ReplayConfig(iteration_length=300, mean_over="members", alpha2=0.4)


def _rows(r):
    dec = r.decisions.select("round_id", "user_id", "block", "stage", "choice", "reward", "cluster_used")
    return sorted(map(tuple, dec.collect())), sorted(map(tuple, r.clusters.collect())), sorted(map(tuple, r.cluster_counts.collect()))


def test_stream_of_users_equals_batch(spark):
    log = fx.bandit_log(spark, SF001)
    got = RS.run_stream(spark, log, ReplayConfig(iteration_length=250), fx.K, fx.D, clusters=False, files=6, files_a_batch=1)
    batch = run_fold(log, None, UserUCB(fx.D, fx.K, 0.03))
    key = lambda df: sorted(map(tuple, df.select("round_id", "choice", "reward").collect()))
    assert key(got.decisions) == key(batch.decisions)


def test_stream_in_any_order_with_a_restart_equals_batch(spark, tmp_path, monkeypatch):
    """Files arrive last rounds first, some rounds twice; the process dies inside block 1 and starts again."""
    log = fx.bandit_log(spark, SF001)
    batch = TS.two_stage_replay(log, CFG, fx.K, fx.D)
    source = str(tmp_path / "source")
    schema = log.select("round_id", "user_id", "arms", "rewards").schema

    def arrive(lo, hi):
        log.where(F.col("round_id").between(lo, hi)).write.mode("append").parquet(source)

    def stream():
        return RS.ReplayStream(spark, str(tmp_path / "replay"), CFG, fx.K, fx.D, log.select("user_id").distinct())

    def feed(s):
        q = s.start(spark.readStream.schema(schema).parquet(source))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    one = stream()
    arrive(700, 999)
    feed(one)
    assert one.tables.finished() == -1  # nothing is whole yet
    arrive(250, 720)
    feed(one)
    assert one.tables.finished() == -1
    keep = TS.prune
    with monkeypatch.context() as m:

        def dies(tables, blk, *rest):
            if blk == 1:
                raise RuntimeError("killed")
            return keep(tables, blk, *rest)

        m.setattr(TS, "prune", dies)
        arrive(0, 260)
        with pytest.raises(Exception, match="killed"):
            feed(one)
    again = stream()
    assert again.tables.finished() == 0
    feed(again)
    assert again.tables.finished() == 2
    with pytest.raises(ValueError, match="missing"):
        again.finish(1300)
    assert _rows(again.finish(1000)) == _rows(batch)


def test_blocks_that_become_whole_together_are_one_fold(spark, tmp_path, monkeypatch):
    """Twenty blocks in four micro-batches, some rounds twice: a fold a micro-batch at most, a manifest row a block."""
    log = fx.bandit_log(spark, SF001)
    log = log.unionByName(log.where("round_id % 97 = 3"))
    folds, keep = [], RS.BlockTables.write

    def write(self, name, *rest):
        folds.extend([name] if name == "user" else [])
        return keep(self, name, *rest)

    monkeypatch.setattr(RS.BlockTables, "write", write)
    cfg = ReplayConfig(iteration_length=50)
    got = RS.run_stream(spark, log, cfg, fx.K, fx.D, clusters=False, files=4, files_a_batch=1, folder=str(tmp_path))
    assert 1 <= len(folds) <= 5
    batch = run_fold(fx.bandit_log(spark, SF001), None, UserUCB(fx.D, fx.K, 0.03)).decisions
    want = {r.round_id: (r.choice, r.reward) for r in batch.collect()}
    rows = got.decisions.collect()
    assert len(rows) == 1000 and {r.round_id: (r.choice, r.reward) for r in rows} == want
    assert all(r.block == r.round_id // 50 and r.stage == "user" for r in rows)
    totals = {b: sum(want[i][1] for i in range(50 * b, 50 * b + 50)) for b in range(20)}
    assert {r.block: (r.rounds, r.reward) for r in got.tables.manifest().collect()} == {b: (50, t) for b, t in totals.items()}
