"""The gossip comparator -- buffered agents that share state pairwise.

Per block (in replay order): every agent plays its rounds with the buffered
fold (F5); local vectors are solved (M7); components of the current graph are
counted; then ``n_shares`` times a seeded permutation pairs agents (J10) and
each pulls from its partner (F6), cut pairs leave the graph (J13).

The graph starts complete and only loses pairs, so it is kept as its
complement (the cut pairs, at most one per agent per share step); degrees and
components are computed from that complement without listing all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.functions import linalg as L
from banditflow.operators import graph as G
from banditflow.operators import gossip as GS
from banditflow.operators import state as S
from banditflow.operators.folds import BUF_TYPE, BufferedAgent, run_fold
from banditflow.operators.log import block, replay
from banditflow.plans.two_stage import ReplayResult
from banditflow.session import materialize


def init_agents(users: DataFrame, d: int, zero_block: bool = False) -> DataFrame:
    """Agent state (I, 0, I, 0, 0, []); ``zero_block`` starts the buffer with one zero block (as written)."""
    zero = F.struct(F.array(*[F.lit(0.0)] * (d * d)).alias("A"), L.zeros(d).alias("b"))
    buf = F.array(zero) if zero_block else F.array().cast(BUF_TYPE)
    return users.select("user_id").distinct().select(
        "user_id",
        L.identity(d).alias("cov"),
        L.zeros(d).alias("b"),
        L.identity(d).alias("cov_loc"),
        L.zeros(d).alias("b_loc"),
        F.lit(0).cast("long").alias("t"),
        buf.cast(BUF_TYPE).alias("buf"),
    )


def local_theta(agents: DataFrame, d: int) -> DataFrame:
    """theta from the local model (cov_loc, b_loc), with t."""
    return S.grouped_ridge(agents, d, a_col="cov_loc", b_col="b_loc", keep=["t"])


def gossip_replay(log: DataFrame, order: DataFrame, cfg: ReplayConfig, k: int, d: int) -> ReplayResult:
    rounds = materialize(replay(log, order), by="round_id")
    n_rounds = int(rounds.agg(F.max("round_id")).first()[0]) + 1
    users = materialize(rounds.select("user_id").distinct())
    spark = log.sparkSession
    agents = materialize(init_agents(users, d, zero_block=cfg.reset_t_per_block))
    cuts = spark.createDataFrame([], "src long, dst long")
    parts: list[DataFrame] = []
    counts: list[DataFrame] = []
    kernel = BufferedAgent(d, k, cfg.alpha, cfg.reward, drop_first_at_t0=cfg.reset_t_per_block)
    for blk, t1 in enumerate(range(0, n_rounds, cfg.block_length)):
        t2 = min(t1 + cfg.block_length, n_rounds)
        if cfg.reset_t_per_block:
            agents = agents.withColumn("t", F.lit(0).cast("long"))
        res = run_fold(block(rounds, t1, t2), agents, kernel)
        agents = res.state
        parts.append(res.decisions.withColumn("block", F.lit(blk)))
        theta = materialize(local_theta(agents, d))
        clusters = G.complement_components(users, cuts)
        n_cuts = cuts.select(F.count(F.lit(1))).scalar()
        n_pairs = users.select((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long")).scalar()
        counts.append(
            clusters.agg(F.count_distinct("cluster_id").alias("n_clusters")).select(
                F.lit(blk).alias("block"),
                F.lit(t1).cast("long").alias("from_round"),
                F.lit(t2).cast("long").alias("to_round"),
                F.col("n_clusters").cast("long").alias("n_clusters"),
                (n_pairs - n_cuts).alias("n_edges"),
            )
        )
        for s in range(cfg.n_shares):
            pairs = GS.partner_pairs(users, seed=cfg.seed + blk * cfg.n_shares + s)
            new, cut = GS.share(agents, theta, pairs, None, cfg.alpha2, as_written=cfg.as_written_share, cuts=cuts)
            new = materialize(new)
            agents = new.select("user_id", "cov", "b", "cov_loc", "b_loc", "t", "buf")
            cut_pairs = new.where(F.col("reset") if not cfg.as_written_share else F.col("user_id") != F.col("p_user_id"))
            cut_pairs = cut_pairs.select(
                F.least("user_id", "p_user_id").alias("src"), F.greatest("user_id", "p_user_id").alias("dst")
            )
            cuts = materialize(cuts.unionByName(cut_pairs).distinct())
    decisions = parts[0]
    for p in parts[1:]:
        decisions = decisions.unionByName(p)
    cc = counts[0]
    for c in counts[1:]:
        cc = cc.unionByName(c)
    final_clusters = G.complement_components(users, cuts)
    return ReplayResult(decisions.withColumn("stage", F.lit("agent")), agents, cuts, final_clusters, cc)


def static_agents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A fixed agent table derived from the log (for the single sharing step query):
    (cov, b) over arm 0, local (cov_loc, b_loc) over arm 1, t = rounds, and a buffer
    of one or two blocks by user parity."""
    from banditflow.sources import fixtures as fx

    log = fx.bandit_log(spark, sf)
    d = fx.D
    a0 = log.select("user_id", F.element_at("arms", 1).alias("x"), F.element_at("rewards", 1).alias("r"))
    a1 = log.select("user_id", F.element_at("arms", 2).alias("x"), F.element_at("rewards", 2).alias("r"))
    s0 = S.gram_moment(a0, "user_id", "x", "r", d)
    s1 = S.gram_moment(a1, "user_id", "x", "r", d)
    j = s0.join(s1.select("user_id", F.col("A").alias("cov_loc"), F.col("b").alias("b_loc")), "user_id")
    blk_loc = F.struct(F.col("cov_loc").alias("A"), F.col("b_loc").alias("b"))
    blk_dec = F.struct(F.col("A").alias("A"), F.col("b").alias("b"))
    buf = F.when(F.pmod("user_id", F.lit(2)) == 0, F.array(blk_loc)).otherwise(F.array(blk_loc, blk_dec))
    agents = j.select("user_id", F.col("A").alias("cov"), "b", "cov_loc", "b_loc", "t", buf.alias("buf"))
    theta = local_theta(agents, d)
    return agents, theta
