"""Wide contexts, ordered lists of hot users, line numbers without a sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from banditflow.operators import log as LG
from banditflow.operators import state as S
from banditflow.sources import files
from banditflow.sources import fixtures as fx
from conftest import SF001


def _rounds(spark, n, d, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.35, 7, rng.integers(0, 40, n))  # one key holds a third
    x, r = rng.normal(size=(n, d)), rng.integers(0, 2, n).astype(float)
    rows = [(int(k), v.tolist(), float(w)) for k, v, w in zip(key, x, r)]
    return key, x, r, spark.createDataFrame(rows, "k long, x array<double>, r double").repartition(5)


@pytest.mark.parametrize("d", [4, 64, 128])
def test_block_sums_equal_numpy(spark, monkeypatch, d):
    monkeypatch.setattr(S, "KEY_ROWS", 50)  # the hot key is dealt over tasks
    key, x, r, df = _rounds(spark, 400, d)
    got = {row.k: row for row in S.block_sums(df, "k", "x", "r", d).collect()}
    assert set(got) == set(key.tolist())
    for k, row in got.items():
        mine = key == k
        np.testing.assert_allclose(np.reshape(row.A, (d, d)), x[mine].T @ x[mine], atol=1e-9)
        np.testing.assert_allclose(row.b, x[mine].T @ r[mine], atol=1e-9)
        assert row.t == mine.sum()


def test_wide_state_has_few_expressions_and_merges(spark):
    """d = 128 through Gram, moment, deltas, upsert and solve; the plan does not grow with d^2."""
    key, x, r, df = _rounds(spark, 300, 128)
    st = S.gram_moment(df, "k", "x", "r", 128)
    assert len(st._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    more = S.deltas(df.withColumnRenamed("r", "reward").withColumnRenamed("k", "user_id"), "user_id", 128)
    both = S.merge_state(st.withColumnRenamed("k", "user_id"), more, 128)
    theta = {row.user_id: row for row in S.grouped_ridge(both, 128, keep=["t"]).collect()}
    for k in set(key.tolist()):
        mine = key == k
        want = np.linalg.solve(np.eye(128) + 2 * x[mine].T @ x[mine], 2 * x[mine].T @ r[mine])
        np.testing.assert_allclose(theta[k].theta, want, atol=1e-9)
        assert theta[k].t == 2 * mine.sum()


def test_blocks_equal_generated_sums(spark):
    log = fx.bandit_log(spark, SF001).select("user_id", F.element_at("arms", 1).alias("x"), F.element_at("rewards", 1).alias("r"))
    made = {r.user_id: r for r in S.gram_moment(log, "user_id", "x", "r", fx.D).collect()}
    for r in S.block_sums(log, "user_id", "x", "r", fx.D).collect():
        np.testing.assert_allclose(np.asarray(r.A) + np.eye(fx.D).reshape(-1), made[r.user_id].A, atol=1e-9)
        np.testing.assert_allclose(r.b, made[r.user_id].b, atol=1e-9)


def test_round_lists_of_a_hot_user(spark):
    rows = [(5, 3 * i) for i in range(900)] + [(i % 60, 10_000 + i) for i in range(600)] + [(61, 1)]
    got = LG.round_lists(spark.createDataFrame(rows, "user_id long, round_id long").repartition(7), 40).collect()
    want = {}
    for u, t in sorted(rows):
        want.setdefault(u, []).append(t)
    assert {(r.user_id, r.chunk): r.round_ids for r in got} == {
        (u, i // 40): ts[i : i + 40] for u, ts in want.items() for i in range(0, len(ts), 40)
    }
    assert len(got) == len({(r.user_id, r.chunk) for r in got})
    assert LG.round_lists(spark.createDataFrame([], "user_id long, round_id long"), 40).count() == 0


def test_line_numbers_move_no_wide_rows(spark, tmp_path):
    """Three files cut into many splits: numbers follow the lines, and the rows are not exchanged."""
    lines = [f"{i},{i * 2}.5,{i % 7}.25" for i in range(3000)]
    for part, (lo, hi) in enumerate([(0, 1000), (1000, 1001), (1001, 3000)]):
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines[lo:hi]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = files.read_features(spark, str(tmp_path), 3, 1)
        assert df.rdd.getNumPartitions() > 40
        assert [(r.row_id, r.x) for r in df.orderBy("row_id").collect()] == [(i, [float(v) for v in s.split(",")]) for i, s in enumerate(lines)]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
