"""Replays that are killed and called again; the tables they leave; numbering of chunks."""

import pytest
from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.operators.skew import chunk_numbers, split_hot
from banditflow.plans import blocks as B
from banditflow.plans.lazy import lazy_replay
from banditflow.plans.two_stage import two_stage_replay
from banditflow.sources import fixtures as fx
from conftest import SF001


class Killed(Exception):
    pass


def _rows(r):
    dec = r.decisions.select("round_id", "user_id", "block", "stage", "choice", "reward")
    return (
        sorted(map(tuple, dec.collect())), sorted((x.user_id, tuple(x.A), tuple(x.b), x.t) for x in r.state.collect()),
        sorted(map(tuple, r.clusters.collect())), sorted(map(tuple, r.cluster_counts.collect())),
    )


def _kill(monkeypatch, block, name):
    """The process dies when this table of this block is about to be written (half of it is there already)."""
    keep = B.BlockTables.write

    def write(self, table, df, blk=None, parts=()):
        if (table, blk) == (name, block):
            keep(self, table, df.limit(1), blk, parts)
            raise Killed
        return keep(self, table, df, blk, parts)

    monkeypatch.setattr(B.BlockTables, "write", write)


RUNS = {
    "two_stage": lambda log, folder: two_stage_replay(
        log, ReplayConfig(iteration_length=250, mean_over="members", alpha2=0.4), fx.K, fx.D, folder=folder
    ),
    "lazy": lambda log, folder: lazy_replay(
        log, fx.replay_order(log.sparkSession, SF001), ReplayConfig(warmup_rounds=300, block_length=200, chunk_limit=40, alpha2=0.4),
        fx.K, fx.D, folder=folder,
    ),
}


@pytest.mark.parametrize("replay,table", [("two_stage", "cluster"), ("lazy", "state")])
def test_a_killed_replay_goes_on_after_its_last_finished_block(spark, monkeypatch, tmp_path, replay, table):
    log = fx.bandit_log(spark, SF001)
    whole = RUNS[replay](log, None)
    with monkeypatch.context() as m:
        _kill(m, 3, table)
        with pytest.raises(Killed):
            RUNS[replay](log, str(tmp_path))
    tables = B.BlockTables(spark, str(tmp_path))
    assert tables.finished() == 2
    with monkeypatch.context() as m:  # finished blocks are not played again
        keep = B.BlockTables.write
        written = []
        m.setattr(B.BlockTables, "write", lambda self, t, df, b=None, p=(): (written.append(b), keep(self, t, df, b, p))[1])
        resumed = RUNS[replay](log, str(tmp_path))
    assert min(written) == 3
    assert _rows(resumed) == _rows(whole)
    # the manifest has the totals, and only the last state and graph are left
    total = {r.block: r.reward for r in whole.decisions.groupBy("block").agg(F.sum("reward").alias("reward")).collect()}
    got = {r.block: r.reward for r in tables.manifest().groupBy("block").agg(F.sum("reward").alias("reward")).collect()}
    assert got == total and tables.manifest().agg(F.sum("rounds")).first()[0] == 1000
    left = tables.names()
    for name in ("history", "labels", "forest", "state", "models"):
        assert sum(x.startswith(name + "/") for x in left) <= 1, left
    assert sorted(left) == sorted(B.BlockTables(spark, whole.tables.folder).names())


def test_a_finished_replay_plays_nothing(spark, monkeypatch, tmp_path):
    log = fx.bandit_log(spark, SF001)
    first = RUNS["two_stage"](log, str(tmp_path))
    monkeypatch.setattr(B.BlockTables, "write", None)
    assert _rows(RUNS["two_stage"](log, str(tmp_path))) == _rows(first)


def test_chunks_of_hot_keys(spark):
    """A key with a third of the rows, keys at and around the limit, sparse numbers: chunk = floor(position / limit)."""
    rows = [(0, 7 * i) for i in range(400)] + [(1, i) for i in range(40)] + [(2, i) for i in range(41)]
    rows += [(3 + i % 300, 1000 + i) for i in range(700)] + [(9999, -5 - 3 * i) for i in range(95)]
    df = spark.createDataFrame(rows, "k long, o long").withColumn("first", F.lit("x"))
    want, seen = {}, {}
    for k, o in sorted(rows):
        want[k, o] = seen.get(k, 0) // 40
        seen[k] = seen.get(k, 0) + 1
    got = split_hot(df, "k", "o", 40)
    assert got.columns == ["k", "o", "first", "chunk"]
    assert {(r.k, r.o): r.chunk for r in got.collect()} == want and got.count() == len(rows)
    numbers = chunk_numbers(df, "k", "o", 40)
    assert {r.k: r.n_chunks for r in numbers.chunks.collect()} == {0: 10, 2: 2, 9999: 3}
    assert numbers.spans.groupBy("k", "bucket").count().agg(F.max("count")).first()[0] <= 2
    assert chunk_numbers(df, "k", "o", 10**6).spans is None


def test_the_lazy_block_moves_its_payload_once(spark):
    """Arms are in one exchange of the block's plan: the fold's."""
    from banditflow.operators.folds import ClusterSequentialUCB, sequential_fold
    from banditflow.operators.skew import with_chunks
    from banditflow.operators.log import with_cluster
    from banditflow.session import materialize

    log = materialize(fx.bandit_log(spark, SF001))
    clusters = materialize(log.select("user_id").distinct().withColumn("cluster_id", F.lit(0).cast("long")))
    numbers = chunk_numbers(with_cluster(log.select("round_id", "user_id"), clusters), "cluster_id", "round_id", 50)
    out = sequential_fold(
        with_chunks(with_cluster(log, clusters), numbers, "cluster_id", "round_id"), None,
        ClusterSequentialUCB(fx.D, fx.K, 0.03), keys=("cluster_id", "chunk"), payload=("user_id",),
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1, plan


def test_spans_do_not_grow_with_the_distance_of_numbers(spark):
    """Chunks of numbers millions apart, and of a burst beside them: a few buckets a chunk, not one in each quarter limit."""
    rows = [(k, i * 3_000_017 + k) for k in range(5) for i in range(67)] + [(7, i) for i in range(300)] + [(7, 10**12 + i * 10**9) for i in range(90)]
    rows += [(8, 5)] * 25 + [(8, 9 + i) for i in range(30)] + [(9, None), (None, 4)]
    df = spark.createDataFrame(rows, "k long, o long")
    numbers = chunk_numbers(df, "k", "o", 20)
    chunks = sum(r.n_chunks for r in numbers.chunks.collect())
    assert numbers.spans.count() <= 5 * chunks
    got = split_hot(df, "k", "o", 20).collect()
    assert len(got) == len(rows)
    for k in (*range(5), 7):
        ordered = sorted(r.o for r in got if r.k == k)
        assert {r.o: r.chunk for r in got if r.k == k} == {o: i // 20 for i, o in enumerate(ordered)}
    # equal numbers stay together, in the last chunk that starts with them
    assert {r.chunk for r in got if r.k == 8 and r.o == 5} == {1}
    assert {r.chunk for r in got if r.k is None or r.k == 9} == {0}
