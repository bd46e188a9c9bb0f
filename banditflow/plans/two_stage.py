"""Two-stage clustered replay.

Per iteration of L rounds: the first control*L rounds are played per user (F1),
user vectors are solved (M7), the graph is pruned (J8 the first time, J9 after)
and split into connected components (G3), the cluster models are rolled up
(A8) and the remaining rounds are played with the frozen cluster models (F2).

The driver loop only chains DataFrames; what a block leaves is written as tables with a
manifest (``plans.blocks``), so lineage stays one block deep, a lost executor
recomputes at most one block, and a replay that was killed goes on after its last finished
block.  The graph is kept as history, forest and labels (``operators.user_graph``); its edges are
counted from the history only on demand, and listed when they are read.  The values brought to the driver
are totals of a block and counts of the components loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditflow.config import ReplayConfig
from banditflow.functions import linalg as L
from banditflow.operators import graph as G
from banditflow.operators import state as S
from banditflow.operators.folds import ClusterUCB, UserUCB, fold_parts, sequential_fold
from banditflow.operators.log import block
from banditflow.operators.user_graph import UserGraph, count_edges, refresh, standing_edges
from banditflow.plans.blocks import BlockTables, Totals


@dataclass
class ReplayResult:
    decisions: DataFrame  # round_id, user_id, block, stage, choice, reward, x (+ cluster_used)
    state: DataFrame  # user_state
    edges: DataFrame | None  # src, dst, found when read; only where the replay was asked to list them
    clusters: DataFrame | None
    cluster_counts: DataFrame | None  # block, from_round, to_round, n_clusters, n_edges (null where not asked for)
    tables: BlockTables | None = None  # its manifest has rounds and reward by block and stage


COUNTS = "block int, from_round long, to_round long, n_clusters long, n_edges long"
GRAPH = ("history", "forest", "labels")


def user_theta(state: DataFrame, d: int) -> DataFrame:
    """(user_id, theta, t) from (A, b, t) with the batched solver."""
    return S.grouped_ridge(state, d, keep=["t"])


def counts_row(blk: int, t1: int, t2: int, clusters: DataFrame, n_edges: DataFrame | None) -> DataFrame:
    """One cluster_counts row (Q14: filled per block)."""
    n_edges = F.lit(None) if n_edges is None else n_edges.scalar()
    return clusters.agg(F.count_distinct("cluster_id").alias("n_clusters")).select(
        F.lit(blk).alias("block"),
        F.lit(t1).cast("long").alias("from_round"),
        F.lit(t2).cast("long").alias("to_round"),
        F.col("n_clusters").cast("long").alias("n_clusters"),
        n_edges.cast("long").alias("n_edges"),
    )


def cluster_inputs(state: DataFrame, clusters: DataFrame, cstate: DataFrame, counts: DataFrame, mean_over: str, d: int) -> DataFrame:
    """State rows for F2: the user's (A, b, t) plus its cluster's frozen (A, b) and mean t."""
    cm = S.cluster_mean_t(cstate, counts, mean_over).select(
        "cluster_id", F.col("A").alias("cA"), F.col("b").alias("cb"), F.col("mean_t").alias("ct")
    )
    return state.join(clusters, "user_id", "left").join(cm, "cluster_id", "left").select(
        "user_id", "A", "b", "t",
        F.coalesce("cA", L.identity(d)).alias("cA"),
        F.coalesce("cb", L.zeros(d)).alias("cb"),
        F.col("ct").cast("double").alias("ct"),
    )


def all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prune(tables: BlockTables, blk: int, state: DataFrame, cfg: ReplayConfig, d: int) -> tuple[UserGraph, DataFrame | None]:
    """The graph after this block from the one before, written for the next; the number of its edges only on demand."""
    before = None
    if blk and tables.latest("labels", blk - 1) is not None:
        before = UserGraph(*[tables.load(name, tables.latest(name, blk - 1)) for name in GRAPH])
    theta = user_theta(state, d)
    graph = refresh(before, theta, cfg.alpha2, d, write=lambda name, df: tables.write(name, df, blk))
    return graph, count_edges(graph.history, cfg.alpha2, d) if cfg.list_edges else None


def edges_after(tables: BlockTables, blk: int, cfg: ReplayConfig, d: int) -> DataFrame | None:
    """The edges of the graph after a block, where the replay was asked for them."""
    return standing_edges(tables.load("history", tables.latest("history", blk)), cfg.alpha2, d) if cfg.list_edges else None


def drop_graph(tables: BlockTables, blk: int) -> None:
    """Graph tables that a later one replaces."""
    for name in GRAPH:
        last = tables.latest(name, blk)
        old = None if not last else tables.latest(name, last - 1)
        if old is not None:
            tables.drop(name, old)


def play_block(
    tables: BlockTables, blk: int, t1: int, t2: int, state: DataFrame, user_rounds: DataFrame | None,
    cluster_rounds: DataFrame | None, cfg: ReplayConfig, k: int, d: int, clusters: bool = True,
) -> DataFrame:
    """One iteration from the state before it; everything it leaves is in ``tables``.  Returns the state after it.

    ``clusters=False``: no graph is kept (all rounds are played by user).
    """
    totals = []
    last = None
    if user_rounds is not None:
        seen = Totals()
        out = seen.watch(sequential_fold(user_rounds, state, UserUCB(d, k, cfg.alpha, cfg.reward)))
        state = fold_parts(tables.write("user", out, blk, ("_kind",)), UserUCB(d, k, cfg.alpha, cfg.reward)).state
        totals.append(seen.row("user"))
        last = "user"
    if clusters:
        graph, n_edges = prune(tables, blk, state, cfg, d)
        tables.write("counts", counts_row(blk, t1, t2, graph.clusters, n_edges), blk)
    if cluster_rounds is not None:
        kernel = ClusterUCB(d, k, cfg.alpha, cfg.reward)
        cstate = S.rollup_clusters(state, graph.clusters, d)
        bc = S.cluster_block_counts(cluster_rounds, graph.clusters)
        st2 = cluster_inputs(state, graph.clusters, cstate, bc, cfg.mean_over, d)
        seen = Totals()
        out = seen.watch(sequential_fold(cluster_rounds, st2, kernel, track_used=True))
        state = fold_parts(tables.write("cluster", out, blk, ("_kind",)), kernel, track_used=True).state
        totals.append(seen.row("cluster"))
        last = "cluster"
    tables.finish(blk, totals)
    # what the next block does not need: the state inside this block, state and graph of the one before
    if last == "cluster" and user_rounds is not None:
        tables.drop("user", f"{blk}/_kind=0")
    if blk:
        drop_graph(tables, blk)
        for name in ("user", "cluster"):
            tables.drop(name, f"{blk - 1}/_kind=0")
    return state


def play_user_blocks(
    tables: BlockTables, blk: int, last: int, state: DataFrame, rounds: DataFrame, cfg: ReplayConfig, k: int, d: int
) -> DataFrame:
    """Blocks ``blk`` to ``last`` by user, without a graph: one fold, kept as the table of the last block.

    The manifest still has a row a block.  Returns the state after them.
    """
    kernel = UserUCB(d, k, cfg.alpha, cfg.reward)
    out = tables.write("user", sequential_fold(rounds, state, kernel), last, ("_kind",))
    parts = fold_parts(out, kernel)
    block = F.floor(F.col("round_id") / cfg.iteration_length).cast("int")
    tables.finish_many(last, parts.decisions.groupBy(block.alias("block")).agg(
        F.lit("user").alias("stage"), F.count(F.lit(1)).alias("rounds"), F.coalesce(F.sum("reward"), F.lit(0.0)).alias("reward")
    ))
    before = tables.latest("user", blk - 1)
    if before is not None:
        tables.drop("user", f"{before}/_kind=0")
    return parts.state


def state_after(tables: BlockTables, blk: int, cfg: ReplayConfig, k: int, d: int) -> DataFrame:
    """The state that block ``blk`` left."""
    for name, kernel in (("cluster", ClusterUCB(d, k, cfg.alpha, cfg.reward)), ("user", UserUCB(d, k, cfg.alpha, cfg.reward))):
        if tables.has(name, blk):
            return fold_parts(tables.load(name, blk), kernel).state
    raise ValueError(f"block {blk} has no state")


def replayed(tables: BlockTables, n_blocks: int, cfg: ReplayConfig, k: int, d: int, clusters: bool = True) -> ReplayResult:
    """What the blocks 0 .. n_blocks - 1 left, as one result."""
    parts, counts = [], []
    last = n_blocks - 1
    if not clusters:
        for blk in tables.blocks("manifest"):  # the blocks that runs end with
            dec = fold_parts(tables.load("user", blk), UserUCB(d, k, cfg.alpha, cfg.reward)).decisions
            block = F.floor(F.col("round_id") / cfg.iteration_length).cast("int")
            parts.append(dec.withColumn("cluster_used", F.lit(False)).withColumn("block", block).withColumn("stage", F.lit("user")))
        return ReplayResult(all_of(parts), state_after(tables, last, cfg, k, d), None, None, None, tables)
    for blk in range(n_blocks):
        for name, kernel in (("user", UserUCB(d, k, cfg.alpha, cfg.reward)), ("cluster", ClusterUCB(d, k, cfg.alpha, cfg.reward))):
            if tables.has(name, blk):
                used = name == "cluster"
                dec = fold_parts(tables.load(name, blk), kernel, track_used=used).decisions
                dec = dec if used else dec.withColumn("cluster_used", F.lit(False))
                parts.append(dec.withColumn("block", F.lit(blk)).withColumn("stage", F.lit(name)))
        counts.append(tables.read("counts", COUNTS, blk))
    labels = tables.load("labels", tables.latest("labels", last))
    return ReplayResult(
        all_of(parts), state_after(tables, last, cfg, k, d), edges_after(tables, last, cfg, d),
        G.dense_cluster_ids(labels), all_of(counts), tables,
    )


def two_stage_replay(
    log: DataFrame, cfg: ReplayConfig, k: int, d: int, n_rounds: int | None = None, folder: str | None = None
) -> ReplayResult:
    """Run R1 over a log with dense round ids 0..n-1.

    The log is written once, clustered by round: each block reads its own rounds, also when round_id is
    computed (after a filter and renumbering, say).  With ``folder`` the replay can be resumed: called
    again with the same log and settings, it goes on after the last finished block there.
    """
    tables = BlockTables(log.sparkSession, folder)
    if not tables.has("log"):
        tables.write("log", log.repartitionByRange("round_id").sortWithinPartitions("round_id"))
    log = tables.load("log")
    if n_rounds is None:
        n_rounds = int(log.agg(F.max("round_id")).first()[0]) + 1
    length = cfg.iteration_length
    done = tables.finished()
    n_blocks = -(-n_rounds // length)
    state = state_after(tables, done, cfg, k, d) if done >= 0 else S.init_state(log.select("user_id").distinct(), d)
    for blk in range(done + 1, n_blocks):
        t1 = blk * length
        t_mid, t2 = min(t1 + cfg.user_rounds, n_rounds), min(t1 + length, n_rounds)
        state = play_block(
            tables, blk, t1, t2, state, block(log, t1, t_mid) if t_mid > t1 else None,
            block(log, t_mid, t2) if t2 > t_mid else None, cfg, k, d,
        )
    return replayed(tables, n_blocks, cfg, k, d)
