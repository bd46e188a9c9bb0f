"""Pairwise state sharing of the comparator (J10, T3, F6, J13), all as joins + Column logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditflow.functions import linalg as L
from banditflow.functions.draws import mixed
from banditflow.operators.graph import degree, small_side
from banditflow.operators.ordering import global_index


def partner_pairs(users: DataFrame, seed: int = 0) -> DataFrame:
    """X pulls from perm(x): the k-th user by id pairs with the k-th user by a seeded hash.

    The hash mixes id and seed, so each seed gives another random permutation; as in any, an agent may
    draw itself.

    Both orders are distributed dense indexes (``global_index``), joined on k.
    """
    u = users.select("user_id").distinct()
    by_id = global_index(u, "user_id", "k").select("k", F.col("user_id").alias("src"))
    keyed = u.withColumn("_hk", mixed(F.col("user_id").cast("long"), seed))
    by_key = global_index(keyed, ["_hk", "user_id"], "k").select("k", F.col("user_id").alias("dst"))
    return by_id.join(by_key, "k").select("src", "dst")


def cut_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove the (unordered) pairs from the edge set."""
    p = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.select("src", "dst").join(small_side(p), ["src", "dst"], "left_anti")


def _avg_buf(a, b):
    return F.zip_with(
        a, b, lambda x, y: F.struct(L.average(x["A"], y["A"]).alias("A"), L.average(x["b"], y["b"]).alias("b"))
    )


def cut_degree(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Degree in the complete graph minus ``cuts``: n - 1 - (cut pairs of the node)."""
    n = nodes.select(F.count(F.lit(1))).scalar()
    cd = degree(nodes, cuts)
    return cd.select("user_id", (n - 1 - F.col("degree")).cast("long").alias("degree"))


def share(
    agents: DataFrame,
    theta: DataFrame,
    pairs: DataFrame,
    edges: DataFrame | None,
    alpha2: float,
    as_written: bool = False,
    cuts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """one synchronous sharing step; returns (new agent state, pairs to cut).

    Everyone reads the pre-share snapshot.  With an edge between x and its
    partner p: if ||theta_x - theta_p|| >= cb(t_x, t_p) x resets (cov, b) to its
    own local model, empties its buffer and the edge is cut; else, when the
    degrees are equal, (cov, b) are averaged, and the buffers too when equally
    long; otherwise nothing changes.  ``as_written`` takes the partner's local
    model on a reset and cuts every gossiped pair.

    The graph is either an explicit ``edges`` table or, for the comparator whose
    graph starts complete, the complete graph minus ``cuts``.
    """
    nodes = agents.select("user_id")
    deg = degree(nodes, edges) if cuts is None else cut_degree(nodes, cuts)
    cols = ["user_id", "cov", "b", "cov_loc", "b_loc", "t", "buf"]
    me = agents.select(*cols).join(theta.select("user_id", "theta"), "user_id").join(deg, "user_id")
    other = me.select(*[F.col(c).alias(f"p_{c}") for c in me.columns])
    if cuts is None:
        e = edges.select("src", "dst", F.lit(True).alias("edge"))
    else:
        e = cuts.select("src", "dst", F.lit(False).alias("edge"))
    j = (
        me.join(pairs.select(F.col("src").alias("user_id"), F.col("dst").alias("p_user_id")), "user_id")
        .join(other, "p_user_id")
        .join(
            e,
            (F.least("user_id", "p_user_id") == e["src"]) & (F.greatest("user_id", "p_user_id") == e["dst"]),
            "left",
        )
    )
    if cuts is None:
        has_edge = F.coalesce(F.col("edge"), F.lit(False))
    else:
        has_edge = F.coalesce(F.col("edge"), F.col("user_id") != F.col("p_user_id"))
    far = L.l2_distance("theta", "p_theta") >= L.cluster_bound("t", "p_t", alpha2)
    reset = has_edge & far
    avg = has_edge & ~far & (F.col("degree") == F.col("p_degree"))
    same_len = F.size("buf") == F.size("p_buf")
    loc_cov = F.col("p_cov_loc") if as_written else F.col("cov_loc")
    loc_b = F.col("p_b_loc") if as_written else F.col("b_loc")
    empty = F.filter("buf", lambda x: F.lit(False))
    new = j.select(
        "user_id",
        F.when(reset, loc_cov).when(avg, L.average("cov", "p_cov")).otherwise(F.col("cov")).alias("cov"),
        F.when(reset, loc_b).when(avg, L.average("b", "p_b")).otherwise(F.col("b")).alias("b"),
        "cov_loc",
        "b_loc",
        "t",
        F.when(reset, empty).when(avg & same_len, _avg_buf(F.col("buf"), F.col("p_buf"))).otherwise(F.col("buf")).alias("buf"),
        reset.alias("reset"),
        avg.alias("averaged"),
        "p_user_id",
    )
    if as_written:
        cut = new.where(F.col("user_id") != F.col("p_user_id"))
    else:
        cut = new.where("reset")
    cut = cut.select(F.col("user_id").alias("src"), F.col("p_user_id").alias("dst"))
    return new, cut
