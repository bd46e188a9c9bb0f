import os
import tempfile

import numpy as np

from banditflow.operators.log import build_log, replay
from banditflow.sources import files
from banditflow.sources import fixtures as fx
from conftest import SF001


import pytest


@pytest.mark.parametrize("split_bytes", [None, 8192])
def test_csv_round_trip(spark, split_bytes):
    """Line order survives files split over several tasks (8 KB splits)."""
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        _round_trip(spark)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _round_trip(spark):
    log = fx.bandit_log(spark, SF001).orderBy("round_id").toPandas()
    tmp = tempfile.mkdtemp(prefix="bf-csv-")
    X = np.stack([np.concatenate(a) for a in log["arms"]])
    np.savetxt(os.path.join(tmp, "X.csv"), X, delimiter=",", fmt="%.17g")
    np.savetxt(os.path.join(tmp, "U.csv"), log["user_id"].to_numpy(), fmt="%d")
    np.savetxt(os.path.join(tmp, "R.csv"), np.stack(log["rewards"]), delimiter=",", fmt="%.17g")
    order = np.array([1 + (p * 7) % len(log) for p in range(len(log))])
    np.savetxt(os.path.join(tmp, "M.csv"), order, fmt="%d")

    feats = files.read_features(spark, os.path.join(tmp, "X.csv"), fx.K, fx.D)
    users = files.read_users(spark, os.path.join(tmp, "U.csv"))
    rew = files.read_rewards(spark, os.path.join(tmp, "R.csv"), fx.K)
    built = build_log(feats, users, rew, fx.K, fx.D).orderBy("row_id").toPandas()
    assert (built["row_id"].to_numpy() == np.arange(len(log))).all()
    assert (built["user_id"].to_numpy() == log["user_id"].to_numpy()).all()
    for a, b in zip(built["arms"], log["arms"]):
        assert np.array_equal(np.stack(a), np.stack(b))
    o = files.read_order(spark, os.path.join(tmp, "M.csv"))
    rep = replay(built.pipe(lambda p: spark.createDataFrame(p[["row_id", "user_id"]])), o).toPandas()
    assert len(rep) == len(log) and rep["round_id"].nunique() == len(log)


def test_curve_sinks(spark):
    from banditflow.plans.evaluation import flagship_curve

    tmp = tempfile.mkdtemp(prefix="bf-sink-")
    curve = flagship_curve(spark, SF001)
    files.write_curve(curve, os.path.join(tmp, "curve"))
    back = spark.read.parquet(os.path.join(tmp, "curve"))
    assert back.count() == 1000
    assert set(back.columns) == {"round_id", "cum_reward", "cum_random", "ratio"}


def test_malformed_numbers_fail(spark, tmp_path):
    import pytest

    (tmp_path / "u.csv").write_text("1\n1.0\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_users(spark, str(tmp_path / "u.csv")).collect()


def test_no_local_folder_on_a_cluster():
    import pytest

    from banditflow.session import ensure_checkpoint_dir

    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class getConf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_load_log(spark, tmp_path):
    """Files to a replay-ready log: K and d from the files, users with few rounds left out, rounds renumbered."""
    rows = [(i, u) for i, u in enumerate([7, 8, 7, 9, 7, 8, 7, 9])]
    (tmp_path / "x.csv").write_text("".join(",".join(str(i * 10 + j) for j in range(6)) + "\n" for i, _ in rows))
    (tmp_path / "u.csv").write_text("".join(f"{u}\n" for _, u in rows))
    (tmp_path / "r.csv").write_text("".join(f"{i % 2},0,{i}\n" for i, _ in rows))
    (tmp_path / "l.csv").write_text("".join(f"{i * 10 + 2}\n" for i, _ in rows))
    x, u, r, label = (str(tmp_path / f"{n}.csv") for n in "xurl")
    got = files.load_log(spark, x, u, r, min_rounds=3).orderBy("round_id").collect()
    assert [(g.round_id, g.user_id) for g in got] == [(0, 7), (1, 7), (2, 7), (3, 7)]
    assert got[1].arms == [[20.0, 21.0], [22.0, 23.0], [24.0, 25.0]] and got[1].rewards == [0.0, 0.0, 2.0]
    few = files.load_log(spark, x, u, label, label=True, max_rounds=5).orderBy("round_id").collect()
    assert len(few) == 5 and few[3].arms == [[float(30 + j)] for j in range(6)] and few[3].label == 32.0


def test_blocks_read_their_own_rounds(spark):
    """A replay's log is clustered by its computed round_id: ranges of files are disjoint and pushed down."""
    from banditflow.operators.log import block, filter_active_users, renumber_rounds
    from banditflow.session import materialize
    from pyspark.sql import functions as F

    log = filter_active_users(fx.bandit_log(spark, SF001), 55).withColumnRenamed("round_id", "row_id")
    log = materialize(renumber_rounds(log, "row_id", "round_id"), by="round_id")
    ranges = log.groupBy(F.input_file_name().alias("f")).agg(F.min("round_id").alias("a"), F.max("round_id").alias("z"))
    ranges = sorted((r.a, r.z) for r in ranges.collect())
    assert all(z < a for (_, z), (a, _) in zip(ranges, ranges[1:]))
    plan = block(log, 100, 200)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(round_id,100)" in plan and "LessThan(round_id,200)" in plan
