"""Headline timings of the replays on the bandit log built from $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Every query runs to completion through the no-op sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from pyspark.sql import functions as F

    from banditflow.config import ReplayConfig
    from banditflow.operators import evaluate as E
    from banditflow.operators import graph as G
    from banditflow.operators.folds import UserUCB, run_fold
    from banditflow.plans.gossip import gossip_replay
    from banditflow.plans.lazy import lazy_replay
    from banditflow.plans.two_stage import two_stage_replay, user_theta
    from banditflow.session import local_session, materialize
    from banditflow.sources import fixtures as fx

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    log = materialize(fx.bandit_log(spark, sf_dir))
    order = materialize(fx.replay_order(spark, sf_dir))
    n_rounds = log.count()
    half = max(1, n_rounds // 2)
    fifth = max(1, n_rounds // 5)
    k, d = fx.K, fx.D
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # F1 over the whole log + random baseline + normalised curve
    def user_policy():
        res = run_fold(log, None, UserUCB(d, k, 0.03))
        curve = E.normalised_curve(res.decisions, E.random_policy(log))
        total = E.finite_sum(curve).first()[0]
        extra["user_policy_reward"] = res.decisions.agg(F.sum("reward")).first()[0]
        extra["normalised_total"] = round(total, 3)
        return res

    res = timed("user_policy_curve", user_policy)

    # distance join + connected components alone, on the per-user vectors
    def graph():
        theta = materialize(user_theta(res.state, d))
        edges = materialize(G.similar_users(theta, 0.7, d))
        clusters = G.connected_components(theta.select("user_id"), edges)
        extra["edges"] = edges.count()
        extra["clusters"] = clusters.agg(F.count_distinct("cluster_id")).first()[0]

    timed("similarity_join_components", graph)

    def two_stage():
        cfg = ReplayConfig(iteration_length=half, control=0.5, mean_over="members")
        r = two_stage_replay(log, cfg, k, d, n_rounds=n_rounds)
        for out in (r.decisions, r.state, r.cluster_counts):
            _run(out)
        extra["two_stage_reward"] = r.decisions.agg(F.sum("reward")).first()[0]

    timed("two_stage_replay", two_stage)

    def lazy():
        cfg = ReplayConfig(warmup_rounds=fifth, block_length=fifth, chunk_limit=max(1, fifth // 25))
        r = lazy_replay(log, order, cfg, k, d)
        for out in (r.decisions, r.state, r.cluster_counts):
            _run(out)
        extra["lazy_reward"] = r.decisions.agg(F.sum("reward")).first()[0]

    timed("lazy_replay", lazy)

    def gossip():
        cfg = ReplayConfig(block_length=half, n_shares=1)
        r = gossip_replay(log, order, cfg, k, d)
        for out in (r.decisions, r.state, r.cluster_counts):
            _run(out)
        extra["gossip_reward"] = r.decisions.agg(F.sum("reward")).first()[0]

    timed("gossip_replay", gossip)

    print(
        json.dumps(
            {
                "metric": "total_replay_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "rounds": n_rounds,
                "cpus": cpus,
                "checks": extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
