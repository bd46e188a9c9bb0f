"""User graph: distance join, monotone pruning, connected components.

The start graph of the replays is complete; it is never materialised.  The
first prune *is* the distance join (an edge survives iff ||theta_u - theta_v||
<= cb(t_u, t_v)), later prunes only test the edges still present.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.functions import linalg as L
from banditflow.operators.ordering import global_index
from banditflow.session import materialize, materialize_counted, release

#: Above this dimension a grid uses distances to pivots instead of the first coordinates.
PIVOTS_ABOVE = 8
#: So many edges between roots are joined by one task; more go round by round.
FINISH = 1 << 17
#: Users of a cell that a task holds at a time while the users around them stream by, and pairs tested at a time.
HELD, PAIRS = 8192, 1 << 18


def _bound_ok(dist, bound, strict: bool):
    return dist < bound if strict else dist <= bound


def coordinates(base: DataFrame, theta: Column, d: int) -> DataFrame:
    """Adds ``_co``: three coordinates that never differ by more than the vectors are apart.

    The first three of a short vector.  A few coordinates of a long one say little; there they are its
    distances to three pivots far from each other (triangle inequality), found by three aggregates.
    """
    if d <= PIVOTS_ABOVE:
        return base.withColumn("_co", F.array(*[F.element_at(theta, i + 1) if i < d else F.lit(0.0) for i in range(3)]))
    far, co = L.l2_distance(theta, L.zeros(d)), []
    for _ in range(3):
        pivot = base.agg(F.max_by(theta, far)).first()[0] or [0.0] * d
        dist = L.l2_distance(theta, F.array(*[F.lit(float(v)) for v in pivot]))
        far = F.least(far, dist) if co else dist
        co.append(dist)
    return base.withColumn("_co", F.array(*co))


def radius_tier(r_max: Column, r: Column, max_tier: int = 12) -> Column:
    """Tier i holds radii <= r_max / 2^i; one coarser than log2 says, so rounding never breaks that."""
    return F.least(F.lit(max_tier), F.greatest(F.lit(0), F.floor(F.log2(r_max / r)).cast("int") - 1))


def _in_tiers(theta: DataFrame, alpha2: float, d: int, grid_dims: int, max_tier: int) -> tuple[DataFrame, int, Column]:
    """(user_id, theta, t, f, _r, _co, _tier) as a written table, the grid's dimensions and the largest radius."""
    # read several times (both join sides and the radius scale): write it once
    base = theta.select("user_id", "theta", "t", L.confidence_radius("t").alias("f")).withColumn("_r", F.lit(alpha2) * F.col("f"))
    base = materialize(base if d <= PIVOTS_ABOVE else coordinates(materialize(base), F.col("theta"), d))
    if d <= PIVOTS_ABOVE:
        base = coordinates(base, F.col("theta"), d)
    r_max = base.select(F.max("_r")).scalar()
    return base.withColumn("_tier", radius_tier(r_max, F.col("_r"), max_tier)), max(1, min(grid_dims, d, 3)), r_max


def _grid_cells(level: Column, r_max: Column, g: int, prefix: str = "c") -> list[Column]:
    width = F.lit(2.0) * r_max * F.pow(F.lit(0.5), level)
    return [F.floor(F.element_at("_co", i + 1) / width).cast("long").alias(f"{prefix}{i}") for i in range(g)]


def candidate_pairs(theta: DataFrame, alpha2: float, d: int, grid_dims: int = 3, max_tier: int = 12) -> DataFrame:
    """Pairs of users (src, theta_s, t_s, dst, theta_d, t_d) that a grid join cannot rule out, each once.

    Each user has a radius r = alpha2 f(t) (f decreasing), and a pair is an edge only if
    ||theta_u - theta_v|| <= r_u + r_v.  Users are put in radius tiers
    (tier i holds radii <= R / 2^i, R the largest radius); a pair whose lower
    tier is i is within 2 R / 2^i, so it is found by an equi join on cells of
    that width on up to three coordinates, the user of tier i in its own
    cell against the other user expanded to the neighbouring cells of the
    tier-i grid.  Users with much history therefore meet only close
    neighbours, even when a few new users (t = 0) are in the table.  A hot cell is a skewed
    sort-merge key that AQE splits.
    """
    base, g, r_max = _in_tiers(theta, alpha2, d, grid_dims, max_tier)
    home = base.select(
        F.col("user_id").alias("src"), F.col("theta").alias("theta_s"), F.col("t").alias("t_s"),
        F.col("_tier").alias("lvl"), F.col("_tier").alias("tier_s"), *_grid_cells(F.col("_tier"), r_max, g),
    )
    offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=g)])
    probe = (
        base.select("user_id", "theta", "t", "_tier", "_co", F.explode(F.sequence(F.lit(0), F.col("_tier"))).alias("lvl"))
        .select(
            F.col("user_id").alias("dst"), F.col("theta").alias("theta_d"), F.col("t").alias("t_d"),
            F.col("_tier").alias("tier_d"), "lvl", *_grid_cells(F.col("lvl"), r_max, g, "h"), F.explode(offsets).alias("_off"),
        )
        .select(
            "dst", "theta_d", "t_d", "tier_d", "lvl",
            *[(F.col(f"h{i}") + F.element_at("_off", i + 1)).alias(f"c{i}") for i in range(g)],
        )
    )
    pairs = home.join(probe, ["lvl", *[f"c{i}" for i in range(g)]])
    # same tier: both orders meet, keep one; lower tier at home: the only meeting
    return pairs.where((F.col("tier_d") > F.col("tier_s")) | (F.col("src") < F.col("dst")))


def similar_users(
    theta: DataFrame, alpha2: float, d: int, grid_dims: int = 3, strict: bool = False, max_tier: int = 12
) -> DataFrame:
    """Edges (src < dst) between users whose vectors are within the cluster bound.

    An exact test of the pairs of ``candidate_pairs``' grid, but a pair becomes a row only when it is an edge: the
    users of a cell are held in chunks of ``HELD`` by a task and those around them stream by, tested in blocks.
    This lists every edge, a quadratic number where groups are dense; components alone come from
    ``operators.user_graph``.  ``strict`` keeps dist < cb instead of <= (the comparator's rule).
    """
    base, g, r_max = _in_tiers(theta, alpha2, d, grid_dims, max_tier)
    at = ["lvl", *[f"c{i}" for i in range(g)]]
    row = ["user_id", "theta", "f", "_tier"]
    homes = base.select(*row, F.col("_tier").alias("lvl"), *_grid_cells(F.col("_tier"), r_max, g))
    cells = materialize(homes.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("chunks")))
    levels = base.select(*row, "_co", F.explode(F.sequence(F.lit(0), F.col("_tier"))).alias("lvl"))
    steps = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=g)])
    around = levels.select(*row, "lvl", *_grid_cells(F.col("lvl"), r_max, g), F.explode(steps).alias("_off"))
    around = around.select(*row, "lvl", *[(F.col(f"c{i}") + F.element_at("_off", i + 1)).alias(f"c{i}") for i in range(g)])
    keys = [*at, "chunk"]
    homes = homes.join(cells, at).withColumn("chunk", F.pmod(F.xxhash64("user_id"), F.col("chunks")).cast("int"))
    probes = around.join(cells, at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = homes.select(*keys, *row, F.lit(0).alias("side")).unionByName(probes.select(*keys, *row, F.lit(1).alias("side")))
    # few rows, much work each: not fewer tasks than cores
    spread = max(int(theta.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * theta.sparkSession.sparkContext.defaultParallelism)
    dealt = met.repartition(spread, *keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(_edges_of(keys, alpha2, d, strict), "src long, dst long")


def _edges_of(keys: list[str], alpha2: float, d: int, strict: bool):
    """Stream by (cell, chunk), held users first -> the edges between held and passing users."""

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids = batch.column("user_id")
        theta = np.asarray(batch.column("theta").flatten(), dtype=np.float64).reshape(batch.num_rows, d)
        return ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), theta, np.asarray(batch.column("f")), np.asarray(batch.column("_tier"))

    def meet(h: tuple, p: tuple) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // len(h[1]))
        for lo in range(0, len(p[1]), step):
            known, ids, theta, f, tier = (x[lo : lo + step] for x in p)
            # summed in the order of the column expression
            square = np.zeros((len(ids), len(h[1])))
            for i in range(d):
                diff = theta[:, i, None] - h[2][None, :, i]
                square += np.multiply(diff, diff, out=diff)
            bound = alpha2 * (h[3][None, :] + f[:, None])
            dist = np.sqrt(square, out=square)
            ok = dist < bound if strict else dist <= bound
            # same tier: both orders meet, keep one; lower tier at home: the only meeting
            ok &= (tier[:, None] > h[4][None, :]) | (known[:, None] & h[0][None, :] & (h[1][None, :] < ids[:, None]))
            pi, hi = np.nonzero(ok)
            if len(pi):
                a, b = h[1][hi], ids[pi]
                if not (known.all() and h[0].all()):  # least and greatest pass over nulls
                    a, b = np.where(h[0][hi], a, b), np.where(known[pi], b, a)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in [*keys, "side"]])
            cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                here = tuple(cols[:-1, start].tolist())
                if here != key:
                    key, held = here, []
                part = rows(batch.slice(start, end - start))
                if cols[-1, start] == 0:
                    held.append(part)
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                yield from meet(held[0], part)

    return run


#: So many users at most go to every task of a join with the edges; more are joined by a shuffle.
FEW_USERS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A written table a row or so a user, broadcast while it is counted as small: the edges are not shuffled then."""
    df, n = materialize_counted(df)
    return F.broadcast(df) if n <= FEW_USERS else df


def prune_edges(edges: DataFrame, theta: DataFrame, alpha2: float, strict: bool = False) -> DataFrame:
    """Keep only the edges still within the bound under the new theta (removed edges never return)."""
    theta = small_side(theta.select("user_id", "theta", "t"))
    s = theta.select(F.col("user_id").alias("src"), F.col("theta").alias("theta_s"), F.col("t").alias("t_s"))
    d_ = theta.select(F.col("user_id").alias("dst"), F.col("theta").alias("theta_d"), F.col("t").alias("t_d"))
    j = edges.select("src", "dst").join(s, "src").join(d_, "dst")
    dist = L.l2_distance("theta_s", "theta_d")
    bound = L.cluster_bound("t_s", "t_d", alpha2)
    return j.where(_bound_ok(dist, bound, strict)).select("src", "dst")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of incident edges per node (0 for isolated nodes)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("user_id"))  # the edges are read once
    deg = ends.groupBy("user_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("user_id").join(deg, "user_id", "left").select(
        "user_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )


def _stars(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (root, parent) with parent <= root, until every parent is its own parent.

    The depth at least halves with each written table, so a chain of n takes log2(n) of them.
    """
    parent = materialize(parent)
    while True:
        up = parent.select(F.col("root").alias("parent"), F.col("parent").alias("up"))
        jumped = materialize(parent.select("root", "parent").join(up, "parent").select(
            "root", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")
        ))
        release(parent)
        parent = jumped
        if not parent.agg(F.max("moved")).first()[0]:
            return parent


@dataclass
class Forest:
    labels: DataFrame  # node, label: the smallest node of its component, for every node that has an edge
    forest: DataFrame  # the edges of a spanning forest, as they came
    tables: list[DataFrame]  # written tables behind both: release them when both are used


def _union_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join, then every node with its root, by union-find over at most ``FINISH`` edges."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    kind = None
    for batch in batches:
        kind, joins = batch.column("edge").type, []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                joins.append(i)
        none = pa.nulls(len(joins), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, batch.column("edge").take(pa.array(joins, pa.int64()))], names=["root", "parent", "edge"])
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64()), pa.nulls(len(nodes), kind)],
            names=["root", "parent", "edge"],
        )


def spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", carry: tuple[str, ...] = ()) -> Forest:
    """Components and a spanning forest of undirected edges; forest edges keep the columns ``carry``.

    Each round hooks every root to its smallest neighbouring root by one of the edges between them, flattens the
    trees by pointer jumping and replaces the edges by those left between roots.  A root outlives two rounds only
    if it is the smallest within two steps, and then it takes all its neighbours: the roots halve every two
    rounds whatever the shape.  When at most ``FINISH`` edges are left, one task joins them.
    """
    a, b = F.col(src), F.col(dst)
    edge = F.struct(*[F.col(c) for c in dict.fromkeys((src, dst, *carry))]).alias("edge")
    pair = edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), edge)
    left, n = materialize_counted(pair.groupBy("a", "b").agg(F.min("edge").alias("edge")))
    kind = left.schema["edge"].dataType
    labels, picked, used = None, [], [left]
    while n:
        if n <= FINISH:
            schema = T.StructType([T.StructField("root", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("edge", kind)])
            rest = materialize(left.repartition(1).mapInArrow(_union_rest, schema))
            parent = rest.where("root is not null").select("root", "parent")
            picked.append(rest.where("root is null").select("edge.*"))
            used.append(rest)
        else:
            ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge"))
            hooked = materialize(ends.groupBy(F.col("a").alias("root")).agg(F.min(F.struct("b", "edge")).alias("m")))
            picked.append(hooked.where(F.col("m.b") < F.col("root")).select("m.edge.*"))
            parent = _stars(hooked.select("root", F.least("root", "m.b").alias("parent")))
            used += [hooked, parent]
        if labels is None:
            labels = parent.select(F.col("root").alias("node"), F.col("parent").alias("label"))
        else:
            up = parent.select(F.col("root").alias("label"), "parent")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        if n <= FINISH:
            break
        pa_ = parent.select(F.col("root").alias("a"), F.col("parent").alias("pa"))
        pb_ = parent.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        fewer = left.join(pa_, "a").join(pb_, "b").where(F.col("pa") != F.col("pb"))
        fewer = fewer.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.min("edge").alias("edge"))
        left, n = materialize_counted(fewer)
        used.append(left)
    if labels is None:  # no edges: the empty table has the right columns
        none = left.select(F.col("a").alias("node"), F.col("b").alias("label"))
        return Forest(none, left.select("edge.*"), used)
    if len(picked) > 1:
        labels = materialize(labels)
        used.append(labels)
    forest = picked[0]
    for p in picked[1:]:
        forest = forest.unionByName(p)
    return Forest(labels, forest, used)


def edge_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): the smallest node of its component, for every node that has an edge."""
    found = spanning_forest(edges, src, dst)
    labels = materialize(found.labels)
    release(*found.tables)
    return labels


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label = smallest user_id of the node's component (isolated nodes label themselves)."""
    found = edge_components(edges).withColumnRenamed("node", "user_id")
    return nodes.select("user_id").distinct().join(found, "user_id", "left").select(
        "user_id", F.coalesce("label", "user_id").alias("label")
    )


def dense_cluster_ids(labels: DataFrame) -> DataFrame:
    """cluster_id = dense rank (0-based) of the component label."""
    ids = global_index(labels.select("label").distinct(), "label", "cluster_id")
    return labels.join(ids, "label").select("user_id", "cluster_id")


def connected_components(nodes: DataFrame, edges: DataFrame, dense: bool = True) -> DataFrame:
    """G3 + G4: (user_id, cluster_id) with cluster ids 0..S-1 ordered by the smallest member.

    ``dense=False`` keys clusters by their smallest member instead (same partition of
    the users, no extra global numbering pass) -- what the replay loops use inside.
    """
    labels = component_labels(nodes, edges)
    if dense:
        return dense_cluster_ids(labels)
    return labels.select("user_id", F.col("label").alias("cluster_id"))


def n_clusters(clusters: DataFrame) -> DataFrame:
    """Number of components."""
    return clusters.agg(F.count_distinct("cluster_id").alias("n_clusters"))


def complement_components(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """G3 on a complete graph minus a set of cut pairs, without listing its edges.

    A node's best neighbour label is the smallest label among all nodes except itself and its cut
    partners: nodes are ranked by (label, node), and for each node the first rank not taken by its
    excluded set (the "mex" of their ranks) names that neighbour.  Every label hooks to the smallest
    label its nodes see, trees are flattened by pointer jumping, until no label changes.  Work per
    round is O(nodes + cuts); no pair of nodes is ever enumerated.
    """
    from banditflow.operators.ordering import key_index

    # A split (S, rest) of K_n minus the cuts needs every crossing pair cut, at least
    # |S| (n - |S|) >= n - 1 cuts; with fewer the graph is connected: one cluster.
    n_nodes = nodes.select("user_id").distinct().count()
    n_cuts = cuts.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().count()
    if n_cuts < n_nodes - 1:
        return nodes.select("user_id").distinct().withColumn("cluster_id", F.lit(0).cast("long"))

    und = cuts.select(F.col("src").alias("v"), F.col("dst").alias("u")).unionAll(
        cuts.select(F.col("dst").alias("v"), F.col("src").alias("u"))
    )
    und = materialize(und.distinct())
    labels = materialize(nodes.select(F.col("user_id").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        ranked = global_index(labels, ["label", "node"], "pos")
        excl = labels.select(F.col("node").alias("v"), F.col("node").alias("u")).unionAll(und)
        excl_pos = excl.join(ranked.select(F.col("node").alias("u"), "pos"), "u").select("v", "pos")
        seq = key_index(excl_pos, "v", "pos", "i")
        mex = seq.groupBy("v").agg(
            F.coalesce(F.min(F.when(F.col("pos") != F.col("i"), F.col("i"))), F.count(F.lit(1))).alias("mex")
        )
        best = mex.join(ranked.select(F.col("pos").alias("mex"), F.col("label").alias("seen")), "mex")
        hooked = (
            labels.join(best.select(F.col("v").alias("node"), "seen"), "node", "left")
            .groupBy(F.col("label").alias("root"))
            .agg(F.least(F.col("label"), F.min("seen")).alias("parent"))
        )
        parent = _stars(hooked)
        if parent.where(F.col("parent") != F.col("root")).isEmpty():
            return dense_cluster_ids(labels.select(F.col("node").alias("user_id"), "label"))
        up = parent.select(F.col("root").alias("label"), "parent")
        labels = materialize(labels.join(up, "label").select("node", F.col("parent").alias("label")))
