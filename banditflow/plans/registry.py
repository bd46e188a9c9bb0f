"""Registered queries: one per operator of the inventory, each over the whole test tables.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame; the DuckDB
twins are in ``banditflow.oracles``.  Doubles are rounded to 6 decimals and
column names match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.functions import linalg as L
from banditflow.functions.draws import mixed
from banditflow.operators import evaluate as E
from banditflow.operators import graph as G
from banditflow.operators import gossip as GS
from banditflow.operators import log as LG
from banditflow.operators import state as S
from banditflow.operators.folds import BufferedAgent, UserUCB, run_fold
from banditflow.operators.ordering import global_index
from banditflow.operators.user_graph import similar_links
from banditflow.sources import fixtures as fx
from banditflow.sources.testdata import read_table

K, D = fx.K, fx.D
ALPHA, ALPHA2 = 0.03, 0.7
GRAPH_ALPHA2 = 0.2  # static graph fixture
SHARE_ALPHA2 = 0.45  # static sharing fixture: near and far partners both occur
ACTIVE_MIN = 70  # makes the active-user filter a real filter at sf0.01
STAGE_L = 5000
CHUNK = 20
R = 6  # rounding digits of reported doubles


def _r(c, digits: int = R):
    return F.round(c, digits)


def _ra(c, digits: int = R):
    return L.round_array(c, digits)


def _log(spark, sf):
    return fx.bandit_log(spark, sf)


def _n(spark, sf):
    """Number of rounds as a scalar subquery (lazy, grows with the table)."""
    return read_table(spark, sf, "events").select(F.count(F.lit(1))).scalar()


# ------------------------------------------------------------------ static per-user vectors (fixture user_vec)
def user_vec(spark, sf, arm: int = 0) -> DataFrame:
    """theta = sum r x / count and t = count over one fixed arm."""
    log = _log(spark, sf)
    x = F.element_at("arms", arm + 1)
    r = F.element_at("rewards", arm + 1)
    agg = log.groupBy("user_id").agg(
        *[F.sum(r * F.element_at(x, i + 1)).alias(f"_s{i}") for i in range(D)], F.count(F.lit(1)).alias("t")
    )
    return agg.select(
        "user_id", F.array(*[F.col(f"_s{i}") / F.col("t") for i in range(D)]).alias("theta"), "t"
    )


def arm0_state(log: DataFrame) -> DataFrame:
    """(A, b, t) per user over arm 0 (A5-A7 on a fixed arm)."""
    return arm_state(log, 0)


def arm_state(log: DataFrame, arm: int) -> DataFrame:
    x = log.select("user_id", F.element_at("arms", arm + 1).alias("x"), F.element_at("rewards", arm + 1).alias("r"))
    return S.gram_moment(x, "user_id", "x", "r", D)


def ridge_vec(spark, sf, arm: int = 0) -> DataFrame:
    """Static user vectors for the graph operators: theta = A^-1 b over one fixed arm, t = rounds."""
    return S.grouped_ridge(arm_state(_log(spark, sf), arm), D, keep=["t"])


def _edges(spark, sf):
    return G.similar_users(ridge_vec(spark, sf, 0), GRAPH_ALPHA2, D)


def _clusters(spark, sf):
    users = _log(spark, sf).select("user_id").distinct()
    return G.connected_components(users, similar_links(ridge_vec(spark, sf, 0), GRAPH_ALPHA2, D))


def _ucb_frame(spark, sf) -> DataFrame:
    """Rounds with a static user model: theta from user_vec, A^-1 = I / (1 + t)."""
    uv = user_vec(spark, sf)
    a_inv = F.transform(L.identity(D), lambda v: v / (F.col("t") + 1.0))
    return _log(spark, sf).join(uv, "user_id").withColumn("a_inv", a_inv)


# ------------------------------------------------------------------ queries
def q_log_load(spark, sf):
    log = LG.build_log(fx.features(spark, sf), fx.users(spark, sf), fx.reward_rows(spark, sf), K, D)
    return log.select("row_id", "user_id", "arms", "rewards")


def q_reshape_arms(spark, sf):
    return fx.features(spark, sf).select("row_id", LG.reshape_arms("x", K, D).alias("arms"))


def q_log_shape(spark, sf):
    return LG.log_shape(_log(spark, sf))


def q_pick_reward(spark, sf):
    log = _log(spark, sf).withColumn("choice", F.pmod("round_id", F.lit(K)).cast("int"))
    return log.select("round_id", "choice", L.pick("arms", "choice").alias("x"), L.pick_reward("rewards", "choice").alias("reward"))


def q_label_match_reward(spark, sf):
    log = fx.label_log(spark, sf).withColumn("choice", E.random_arm(F.col("round_id"), K))
    hits = F.transform("arms", lambda x: L.match_reward(x, F.col("label")))
    return log.select(
        "round_id",
        "choice",
        L.match_reward(L.pick("arms", "choice"), "label").alias("reward"),
        F.aggregate(hits, F.lit(0.0), lambda a, v: a + v).alias("n_hits"),
    )


def q_block_filter(spark, sf):
    n = _n(spark, sf)
    return LG.block(_log(spark, sf), F.floor(n / 4), F.floor(n / 2)).select("round_id", "user_id")


def q_stage_assignment(spark, sf):
    return LG.assign_stage(_log(spark, sf), STAGE_L, 0.5).select("round_id", "block", "stage")


def q_round_cap(spark, sf):
    """The cap is a parameter; here four fifths of the rounds, at every size."""
    return LG.limit_rounds(_log(spark, sf), F.floor(_n(spark, sf) * 4 / 5)).select("round_id", "user_id")


def q_active_users(spark, sf):
    return LG.active(_log(spark, sf), ACTIVE_MIN)


def q_active_log(spark, sf):
    kept = LG.filter_active_users(_log(spark, sf), ACTIVE_MIN).select(F.col("round_id").alias("orig_round"), "user_id")
    return LG.renumber_rounds(kept, "orig_round", "round_id")


def q_replay_order(spark, sf):
    return LG.replay(_log(spark, sf).select("round_id", "user_id"), fx.replay_order(spark, sf)).select(
        "round_id", "src_row", "user_id"
    )


def q_user_index(spark, sf):
    log = _log(spark, sf)
    return LG.with_user_index(log.select("round_id", "user_id"), LG.user_index(log)).select("round_id", "user_idx")


def q_user_count(spark, sf):
    return LG.user_count(_log(spark, sf))


def q_user_seq(spark, sf):
    return LG.user_seq(_log(spark, sf).select("round_id", "user_id")).select("round_id", "user_id", "seq")


def q_rounds_by_user(spark, sf):
    return LG.rounds_by_user(_log(spark, sf))


LIST_CHUNK = 25


def q_round_lists(spark, sf):
    return LG.round_lists(_log(spark, sf).select("round_id", "user_id"), LIST_CHUNK)


def q_csv_log_load(spark, sf):
    """The log written as headerless CSV files and loaded again, rounds of frequent users renumbered."""
    import uuid

    from banditflow.session import ensure_checkpoint_dir
    from banditflow.sources.files import load_log

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    log = _log(spark, sf)
    flat = F.flatten("arms")
    inputs = {
        "x": [F.element_at(flat, i + 1) for i in range(K * D)], "u": [F.col("user_id")],
        "r": [F.element_at("rewards", a + 1) for a in range(K)],
    }
    for name, cols in inputs.items():
        named = [c.alias(f"c{i}") for i, c in enumerate(cols)]
        rows = log.repartitionByRange("round_id").sortWithinPartitions("round_id").select(*named)
        rows.write.mode("overwrite").option("header", "false").csv(f"{base}/{name}")
    return load_log(spark, f"{base}/x", f"{base}/u", f"{base}/r", min_rounds=ACTIVE_MIN)


def q_skew_split(spark, sf):
    from banditflow.operators.skew import split_hot

    return split_hot(_log(spark, sf).select("round_id", "user_id"), "user_id", "round_id", CHUNK).select(
        "round_id", "user_id", "chunk"
    )


def q_cold_log(spark, sf):
    return fx.cold_log(spark, sf).select("round_id", "user_id")


def q_gram_matrix(spark, sf):
    st = arm0_state(_log(spark, sf))
    return st.select("user_id", _ra("A").alias("A"))


def q_reward_moment(spark, sf):
    st = arm0_state(_log(spark, sf))
    return st.select("user_id", _ra("b").alias("b"), "t")


def wide_rounds(spark, sf) -> DataFrame:
    """user_id, x (the whole embedding of the first arm), r (its reward)."""
    emb = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    n = read_table(spark, sf, "embeddings").select(F.count(F.lit(1))).scalar()
    rounds = _log(spark, sf).select("user_id", F.pmod(F.col("round_id") * fx.ARM_STRIDE, n).alias("vec_id"), F.element_at("rewards", 1).alias("r"))
    return rounds.join(emb, "vec_id").select("user_id", "x", "r")


def q_wide_state(spark, sf):
    """A5-A7 with 64 features: 4,096 sums a user."""
    st = S.gram_moment(wide_rounds(spark, sf), "user_id", "x", "r", 64)
    return st.select("user_id", _ra("A", 4).alias("A"), _ra("b", 4).alias("b"), "t")


def q_merge_state(spark, sf):
    log = _log(spark, sf)
    n = _n(spark, sf)
    first = arm0_state(log.where(F.col("round_id") < F.floor(n / 2)))
    second = log.where(F.col("round_id") >= F.floor(n / 2)).select(
        "user_id", F.element_at("arms", 1).alias("x"), F.element_at("rewards", 1).alias("reward")
    )
    merged = S.merge_state(first, S.deltas(second, "user_id", D), D)
    return merged.select("user_id", _ra("A").alias("A"), _ra("b").alias("b"), "t")


def q_grouped_ridge(spark, sf):
    th = S.grouped_ridge(arm0_state(_log(spark, sf)), D)
    return th.select("user_id", _ra("theta").alias("theta"))


def q_similar_users(spark, sf):
    return _edges(spark, sf)


def q_prune_edges(spark, sf):
    return G.prune_edges(_edges(spark, sf), ridge_vec(spark, sf, 1), GRAPH_ALPHA2)


def q_user_clusters(spark, sf):
    return _clusters(spark, sf)


def q_degree(spark, sf):
    return G.degree(_log(spark, sf).select("user_id").distinct(), _edges(spark, sf))


def q_cluster_counts(spark, sf):
    edges = _edges(spark, sf)
    return G.n_clusters(_clusters(spark, sf)).select("n_clusters", edges.select(F.count(F.lit(1))).scalar().alias("n_edges"))


def q_round_cluster(spark, sf):
    return LG.with_cluster(_log(spark, sf).select("round_id", "user_id"), _clusters(spark, sf)).select(
        "round_id", "user_id", "cluster_id"
    )


def q_cluster_block_counts(spark, sf):
    return S.cluster_block_counts(_log(spark, sf), _clusters(spark, sf))


def q_cluster_rollup(spark, sf):
    log = _log(spark, sf)
    clusters = _clusters(spark, sf)
    cs = S.rollup_clusters(arm0_state(log), clusters, D)
    bc = S.cluster_block_counts(log, clusters)
    cm = S.cluster_mean_t(cs, bc, "interactions")
    return cm.select("cluster_id", _ra("A").alias("A"), _ra("b").alias("b"), "t", "members", _r(F.col("mean_t")).alias("mean_t"))


def q_partner_pairs(spark, sf):
    return GS.partner_pairs(_log(spark, sf).select("user_id"), seed=0)


def q_cut_edges(spark, sf):
    return GS.cut_edges(_edges(spark, sf), GS.partner_pairs(_log(spark, sf).select("user_id"), 0))


def q_best_arm(spark, sf):
    df = _ucb_frame(spark, sf)
    return df.select("round_id", L.argmax(L.ucb_scores("arms", "theta", "a_inv", "t", ALPHA, D)).alias("choice"))


def q_ucb_scores(spark, sf):
    df = _ucb_frame(spark, sf)
    return df.select("round_id", _ra(L.ucb_scores("arms", "theta", "a_inv", "t", ALPHA, D)).alias("scores"))


def q_dot_product(spark, sf):
    df = _log(spark, sf).join(user_vec(spark, sf), "user_id")
    return df.select("round_id", _r(L.dot(F.element_at("arms", 1), "theta")).alias("dot"))


def q_outer_product(spark, sf):
    return _log(spark, sf).select("round_id", _ra(L.outer(F.element_at("arms", 1))).alias("xx"))


def q_l2_distance(spark, sf):
    return _log(spark, sf).select(
        "round_id", _r(L.l2_distance(F.element_at("arms", 1), F.element_at("arms", 2))).alias("dist")
    )


def q_cluster_bound(spark, sf):
    uv = user_vec(spark, sf)
    p = GS.partner_pairs(_log(spark, sf).select("user_id"), 0)
    j = p.join(uv.select(F.col("user_id").alias("src"), F.col("t").alias("t_s")), "src").join(
        uv.select(F.col("user_id").alias("dst"), F.col("t").alias("t_d")), "dst"
    )
    return j.select("src", "dst", _r(L.cluster_bound("t_s", "t_d", ALPHA2)).alias("cb"))


def q_buffer_threshold(spark, sf):
    seq = LG.user_seq(_log(spark, sf).select("round_id", "user_id"))
    return seq.select("round_id", _r(L.buffer_threshold("seq")).alias("thresh"))


def q_state_average(spark, sf):
    uv = user_vec(spark, sf)
    p = GS.partner_pairs(_log(spark, sf).select("user_id"), 0)
    j = p.join(uv.select(F.col("user_id").alias("src"), F.col("theta").alias("th_s")), "src").join(
        uv.select(F.col("user_id").alias("dst"), F.col("theta").alias("th_d")), "dst"
    )
    return j.select("src", "dst", _ra(L.average("th_s", "th_d")).alias("avg_theta"))


def q_fifo_buffer(spark, sf):
    log = _log(spark, sf)

    def blk(a):
        x = F.element_at("arms", a)
        return F.struct(L.outer(x).alias("A"), x.alias("b"))

    pushed = L.fifo_push(F.array(blk(2)), blk(1))
    df = log.select("round_id", pushed.alias("buf"))
    return df.select(
        "round_id",
        F.size("buf").alias("size"),
        _ra(L.fifo_peek("buf")["b"]).alias("peek_b"),
        _ra(F.element_at(L.fifo_pop("buf"), 1)["b"]).alias("popped_b"),
        F.size(L.fifo_pop(L.fifo_pop("buf"))).alias("size_after"),
    )


def q_random_policy(spark, sf):
    rp = E.random_policy(_log(spark, sf))
    return rp.select("round_id", "user_id", "choice", "reward", _r(F.col("expected_reward")).alias("expected_reward"))


def q_cum_reward(spark, sf):
    rp = E.random_policy(_log(spark, sf))
    from banditflow.operators.ordering import running_sum

    return running_sum(rp.select("round_id", "reward"), "round_id", ["reward"]).select(
        "round_id", F.col("reward_cum").alias("cum_random")
    )


def _user_policy(spark, sf):
    return run_fold(_log(spark, sf), None, UserUCB(D, K, ALPHA))


def q_user_policy(spark, sf):
    return _user_policy(spark, sf).decisions.select("round_id", "user_id", "choice", "reward")


def q_user_state(spark, sf):
    st = _user_policy(spark, sf).state
    return st.select("user_id", _ra("A", 4).alias("A"), _ra("b", 4).alias("b"), "t")


def _curve(spark, sf):
    log = _log(spark, sf)
    return E.normalised_curve(_user_policy(spark, sf).decisions, E.random_policy(log))


def q_normalised_curve(spark, sf):
    c = _curve(spark, sf)
    return c.select("round_id", "cum_reward", "cum_random", _r(F.col("ratio")).alias("ratio"))


def q_normalised_total(spark, sf):
    return E.finite_sum(_curve(spark, sf)).select(_r(F.col("normalised_total"), 4).alias("normalised_total"))


def q_policy_totals(spark, sf):
    log = _log(spark, sf)
    pol = _user_policy(spark, sf).decisions.select("round_id", "reward").withColumn("stage", F.lit("user"))
    rnd = E.random_policy(log).select("round_id", "reward").withColumn("stage", F.lit("random"))
    dec = pol.unionByName(rnd).withColumn("block", F.floor(F.col("round_id") / STAGE_L).cast("int"))
    return E.policy_totals(dec)


def q_agent_policy(spark, sf):
    res = run_fold(_log(spark, sf), None, BufferedAgent(D, K, ALPHA))
    return res.decisions.select("round_id", "user_id", "choice", "reward")


def q_long_chain_components(spark, sf):
    """G3 on long chains: users in hash order, each linked to the next unless the hash parts them."""
    users = _log(spark, sf).select("user_id").distinct()
    at = global_index(users.withColumn("_hk", mixed(F.col("user_id"), 3)), ["_hk", "user_id"], "k").select("user_id", "k")
    after = at.select(F.col("user_id").alias("dst"), (F.col("k") - 1).alias("k"))
    edges = at.join(after, "k").where(F.pmod("k", F.lit(70)) != 69).select(F.col("user_id").alias("src"), "dst")
    return G.connected_components(users, edges)


def q_share_step(spark, sf):
    from banditflow.plans.gossip import static_agents

    agents, theta = static_agents(spark, sf)
    users = _log(spark, sf).select("user_id").distinct()
    pairs = GS.partner_pairs(users, 0)
    # cut already: every fourth user's own pair (no edge), and the pair with the next user of every
    # fifth (unequal degrees)
    cuts = pairs.where((F.pmod("src", F.lit(4)) == 0) & (F.col("src") != F.col("dst"))).unionAll(
        users.where(F.pmod("user_id", F.lit(5)) == 0).select("user_id", F.col("user_id") + 1)
    )
    cuts = cuts.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    cuts = cuts.join(users, cuts["dst"] == users["user_id"], "left_semi")
    new, cut = GS.share(agents, theta, pairs, None, SHARE_ALPHA2, cuts=cuts)
    return new.select(
        "user_id", _ra("cov").alias("cov"), _ra("b").alias("b"), F.size("buf").alias("buf_len"), "reset", "averaged"
    )


def _cfg_two_stage():
    return ReplayConfig(iteration_length=STAGE_L, control=0.5, mean_over="members")


def q_cluster_policy(spark, sf):
    from banditflow.plans.two_stage import two_stage_replay

    log = _log(spark, sf)
    n = log.count()  # one iteration over the whole log: first half per user, second half clustered
    r = two_stage_replay(log, _cfg_two_stage().with_(iteration_length=n), K, D, n_rounds=n)
    return r.decisions.where(F.col("stage") == "cluster").select("round_id", "user_id", "choice", "reward", "cluster_used")


def q_two_stage_replay(spark, sf):
    from banditflow.plans.two_stage import two_stage_replay

    log = _log(spark, sf)
    n = log.count()  # two iterations of ceil(N / 2) rounds, whatever the table size
    r = two_stage_replay(log, _cfg_two_stage().with_(iteration_length=(n + 1) // 2), K, D, n_rounds=n)
    return r.decisions.select("round_id", "user_id", "block", "stage", "choice", "reward")


def q_two_stage_cluster_counts(spark, sf):
    """The cluster-count curve of the two-stage replay, one row per iteration."""
    from banditflow.plans.two_stage import two_stage_replay

    log = _log(spark, sf)
    n = log.count()
    r = two_stage_replay(log, _cfg_two_stage().with_(iteration_length=(n + 1) // 2, list_edges=True), K, D, n_rounds=n)
    return r.cluster_counts.select("block", "from_round", "to_round", "n_clusters", "n_edges")


def q_two_stage_user_state(spark, sf):
    """user_state after the two-stage replay (A, b rounded to 4 decimals)."""
    from banditflow.plans.two_stage import two_stage_replay

    log = _log(spark, sf)
    n = log.count()
    r = two_stage_replay(log, _cfg_two_stage().with_(iteration_length=(n + 1) // 2), K, D, n_rounds=n)
    return r.state.select("user_id", _ra("A", 4).alias("A"), _ra("b", 4).alias("b"), "t")


def _halves(log: DataFrame, cfg: ReplayConfig, k: int, d: int) -> DataFrame:
    """Decisions of the two-stage replay in two iterations of ceil(N / 2) rounds."""
    from banditflow.plans.two_stage import two_stage_replay

    n = log.count()
    return two_stage_replay(log, cfg.with_(iteration_length=(n + 1) // 2), k, d, n_rounds=n).decisions


def q_two_stage_interactions(spark, sf):
    """R1 with the default mean over the cluster's rounds, on the log with late users (Q1)."""
    dec = _halves(fx.cold_log(spark, sf), ReplayConfig(), K, D)
    return dec.select("round_id", "user_id", "block", "stage", "choice", "reward")


def q_two_stage_label(spark, sf):
    """R1 on logged labels: an arm is rewarded when it is the label; one feature an arm."""
    dec = _halves(fx.label_log(spark, sf), ReplayConfig(mean_over="members", reward="label"), K, 1)
    return dec.select("round_id", "user_id", "block", "stage", "choice", "reward")


def _curve_of(decisions: DataFrame, log: DataFrame) -> DataFrame:
    c = E.normalised_curve(decisions, E.random_policy(log))
    return c.select("round_id", "cum_reward", "cum_random", _r(F.col("ratio")).alias("ratio"))


def q_two_stage_curve(spark, sf):
    """R4 on R1: its reward against the random policy, round by round."""
    return _curve_of(_halves(_log(spark, sf), _cfg_two_stage(), K, D), _log(spark, sf))


def _lazy(spark, sf):
    from banditflow.plans.lazy import lazy_replay

    log = _log(spark, sf)
    n = log.count()  # warm-up of N // 3 rounds, then two blocks, whatever the table size
    w = n // 3
    cfg = ReplayConfig(warmup_rounds=w, block_length=(n - w + 1) // 2, chunk_limit=200)
    return lazy_replay(log, fx.replay_order(spark, sf), cfg, K, D)


def q_lazy_curve(spark, sf):
    """R4 on R2, both policies over the rounds in replay order."""
    return _curve_of(_lazy(spark, sf).decisions, LG.replay(_log(spark, sf), fx.replay_order(spark, sf)))


def q_lazy_replay(spark, sf):
    r = _lazy(spark, sf)
    return r.decisions.select("round_id", "user_id", "block", "stage", "choice", "reward")


def q_lazy_cluster_policy(spark, sf):
    """Lazy replay with one cluster block: warm-up = first half (replay order), F3 chunks of 200 on the rest."""
    from banditflow.plans.lazy import lazy_replay

    log = _log(spark, sf)
    half = log.count() // 2
    cfg = ReplayConfig(warmup_rounds=half, block_length=10**18, chunk_limit=200)
    r = lazy_replay(log, fx.replay_order(spark, sf), cfg, K, D)
    return r.decisions.where(F.col("stage") == "cluster").select("round_id", "user_id", "choice", "reward")


def _gossip(spark, sf, n_shares: int = 1, as_written: bool = False):
    from banditflow.plans.gossip import gossip_replay

    log = _log(spark, sf)
    n = log.count()  # two blocks of ceil(N / 2) rounds with sharing steps between them
    return gossip_replay(log, fx.replay_order(spark, sf), ReplayConfig(
        block_length=(n + 1) // 2, n_shares=n_shares, reset_t_per_block=as_written, as_written_share=as_written
    ), K, D)


def q_gossip_replay(spark, sf):
    return _gossip(spark, sf).decisions.select("round_id", "user_id", "block", "choice", "reward")


def q_gossip_two_shares(spark, sf):
    """R3 with two sharing steps: the second reads what the first left, and its cuts."""
    return _gossip(spark, sf, 2).decisions.select("round_id", "user_id", "block", "choice", "reward")


def q_gossip_as_written(spark, sf):
    """R3 with both as-written rules (Q9 to Q11): t restarts with a block, far partners' models are taken, all pairs met are cut."""
    return _gossip(spark, sf, 2, as_written=True).decisions.select("round_id", "user_id", "block", "choice", "reward")


def q_gossip_cluster_counts(spark, sf):
    """The comparator's cluster-count curve, with two sharing steps a block."""
    return _gossip(spark, sf, 2).cluster_counts


def q_gossip_curve(spark, sf):
    """R4 on R3, both policies over the rounds in replay order."""
    return _curve_of(_gossip(spark, sf).decisions, LG.replay(_log(spark, sf), fx.replay_order(spark, sf)))


def q_stream_replay(spark, sf):
    """The per-user fold as a stream, blocks of STAGE_L rounds."""
    from banditflow.streaming.replay_stream import run_stream

    cfg = ReplayConfig(iteration_length=STAGE_L)
    return run_stream(spark, _log(spark, sf), cfg, K, D, clusters=False).decisions.select("round_id", "user_id", "choice", "reward")


def q_stream_two_stage(spark, sf):
    """R6 with clusters: the two-stage replay fed by a stream (two iterations of ceil(N / 2) rounds)."""
    from banditflow.streaming.replay_stream import run_stream

    log = _log(spark, sf)
    cfg = _cfg_two_stage().with_(iteration_length=(log.count() + 1) // 2)
    r = run_stream(spark, log, cfg, K, D)
    return r.decisions.select("round_id", "user_id", "block", "stage", "choice", "reward")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
