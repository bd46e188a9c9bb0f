import itertools

import numpy as np
from pyspark.sql import functions as F

from banditflow.operators import graph as G
from banditflow.plans import registry as Q
from conftest import SF01
import bruteforce as bf


def test_grid_join_equals_all_pairs(spark):
    th = Q.ridge_vec(spark, SF01, 0)
    rows = th.collect()
    for alpha2 in (0.2, 0.7):
        got = {(r.src, r.dst) for r in G.similar_users(th, alpha2, 4).collect()}
        want = set()
        for a, b in itertools.combinations(sorted(rows, key=lambda r: r.user_id), 2):
            if np.linalg.norm(np.subtract(a.theta, b.theta)) <= bf.cb(a.t, b.t, alpha2):
                want.add((a.user_id, b.user_id))
        assert got == want


def test_grid_join_plan_is_equi_join(spark):
    th = Q.ridge_vec(spark, SF01, 0)
    plan = G.similar_users(th, 0.2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_match_union_find(spark):
    th = Q.ridge_vec(spark, SF01, 0)
    edges = G.similar_users(th, 0.2, 4)
    users = th.select("user_id")
    got = {r.user_id: r.cluster_id for r in G.connected_components(users, edges).collect()}
    want = bf.components([r.user_id for r in users.collect()], [(r.src, r.dst) for r in edges.collect()])
    assert got == want
    assert len(set(got.values())) == 31


def test_complement_components(spark):
    nodes = list(range(12))
    # isolate 11 completely, split {0,1} from the rest except through nothing
    cuts = [(11, j) for j in range(11)] + [(a, b) for a in (0, 1) for b in range(2, 11)]
    cuts = [(min(a, b), max(a, b)) for a, b in cuts]
    ndf = spark.createDataFrame([(n,) for n in nodes], "user_id long")
    cdf = spark.createDataFrame(cuts, "src long, dst long")
    got = {r.user_id: r.cluster_id for r in G.complement_components(ndf, cdf).collect()}
    cutset = set(cuts)
    edges = [(a, b) for a, b in itertools.combinations(nodes, 2) if (a, b) not in cutset]
    assert got == bf.components(nodes, edges)


def test_prune_is_monotone(spark):
    e1 = G.similar_users(Q.ridge_vec(spark, SF01, 0), 0.7, 4)
    e2 = G.prune_edges(e1, Q.ridge_vec(spark, SF01, 1), 0.7)
    assert e2.join(e1, ["src", "dst"], "left_anti").count() == 0
    assert e2.count() <= e1.count()


def test_tiered_grid_with_spread_history(spark):
    """Users with t from 0 to 1e5 fall in different radius tiers; the join still equals all pairs."""
    rng = np.random.default_rng(5)
    n = 400
    t = np.where(rng.random(n) < 0.1, 0, rng.integers(1, 100_000, n))
    th = rng.normal(scale=0.6, size=(n, 4))
    rows = [(i, th[i].tolist(), int(t[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, theta array<double>, t long")
    for alpha2, strict in ((0.7, False), (0.3, True)):
        got = {(r.src, r.dst) for r in G.similar_users(df, alpha2, 4, strict=strict).collect()}
        want = set()
        for a, b in itertools.combinations(range(n), 2):
            dist = np.linalg.norm(th[a] - th[b])
            bound = bf.cb(t[a], t[b], alpha2)
            if (dist < bound) if strict else (dist <= bound):
                want.add((a, b))
        assert got == want
        assert 0 < len(want) < n * (n - 1) // 2


def test_complement_components_few_cuts_is_connected(spark):
    nodes = spark.createDataFrame([(n,) for n in range(6)], "user_id long")
    cuts = spark.createDataFrame([(0, 1), (2, 3), (1, 4)], "src long, dst long")
    got = {r.user_id: r.cluster_id for r in G.complement_components(nodes, cuts).collect()}
    assert got == {n: 0 for n in range(6)}
    # five cuts isolate node 5 exactly: n - 1 cuts are enough to disconnect
    iso = spark.createDataFrame([(j, 5) for j in range(5)], "src long, dst long")
    got = {r.user_id: r.cluster_id for r in G.complement_components(nodes, iso).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def _components(spark, n, pairs):
    edges = spark.createDataFrame(pairs or [(0, 0)], "src long, dst long")
    users = spark.range(n).withColumnRenamed("id", "user_id")
    got = {r.user_id: r.cluster_id for r in G.connected_components(users, edges).collect()}
    assert got == bf.components(list(range(n)), pairs)


def test_components_of_any_shape(spark):
    """Paths in an order that label propagation walks step by step, stars, grids, forests: no cap on rounds."""
    import random

    rng = random.Random(3)
    path = [0, *range(149, 0, -1)]
    _components(spark, 150, list(zip(path, path[1:])))
    _components(spark, 200, [(199, i) for i in range(199)])
    grid = [(i * 12 + j, i * 12 + j + 1) for i in range(12) for j in range(11)] + [(i * 12 + j, i * 12 + 12 + j) for i in range(11) for j in range(12)]
    _components(spark, 144, grid)
    _components(spark, 300, [(rng.randrange(300), rng.randrange(300)) for _ in range(200)])


def test_long_path_takes_few_tables(spark, monkeypatch):
    import random

    nodes = list(range(2000))
    random.Random(5).shuffle(nodes)
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: written.append(1) or keep(df))
    got = G.edge_components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "src long, dst long"))
    assert got.select("label").distinct().collect() == [(0,)] and got.count() == 2000
    assert len(written) < 40


def test_complement_of_dense_cuts(spark):
    """Two groups with every pair between them cut, and a path whose other pairs are all cut."""
    n = 24
    cuts = [(i, j) for i in range(12) for j in range(12, n)]
    users = spark.range(n).withColumnRenamed("id", "user_id")
    got = {r.user_id: r.cluster_id for r in G.complement_components(users, spark.createDataFrame(cuts, "src long, dst long")).collect()}
    assert got == {i: int(i >= 12) for i in range(n)}
    path = {(i, i + 1) for i in range(n - 1)}
    cuts = [(i, j) for i in range(n) for j in range(i + 1, n) if (i, j) not in path]
    got = G.complement_components(users, spark.createDataFrame(cuts, "src long, dst long")).collect()
    assert {r.cluster_id for r in got} == {0}


def test_only_edges_leave_the_similarity_test(spark):
    """Pairs are tested inside tasks: no join makes a row a candidate pair, and a hot cell is held in chunks."""
    rng = np.random.default_rng(9)
    n = 300
    th = np.concatenate([rng.normal(scale=0.01, size=(n // 2, 4)), rng.normal(scale=0.5, size=(n // 2, 4))])
    t = rng.integers(0, 2000, n)
    rows = [(i, th[i].tolist(), int(t[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, theta array<double>, t long")
    edges = G.similar_users(df, 0.2, 4)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "theta_s" not in plan and "MapInArrow" in plan
    held, G.HELD = G.HELD, 16
    try:
        chunked = sorted(map(tuple, G.similar_users(df, 0.2, 4).collect()))
    finally:
        G.HELD = held
    want = [(a, b) for a, b in itertools.combinations(range(n), 2) if np.linalg.norm(th[a] - th[b]) <= bf.cb(t[a], t[b], 0.2)]
    assert sorted(map(tuple, edges.collect())) == chunked == want
    ends = [e for pair in want for e in pair]
    assert {r.user_id: r.degree for r in G.degree(df, edges).collect()} == {i: ends.count(i) for i in range(n)}


def test_clusters_do_not_list_the_edges(spark, monkeypatch):
    """Components come from spanning links, at most one a user, and equal those of all edges; a user without id has none."""
    from banditflow.operators.user_graph import similar_links

    theta = Q.ridge_vec(spark, SF01, 0)
    lost = theta.limit(1).select(F.lit(None).cast("long").alias("user_id"), "theta", "t")
    links = similar_links(theta.unionByName(lost), Q.GRAPH_ALPHA2, 4)
    users = theta.select("user_id")
    edges = G.similar_users(theta, Q.GRAPH_ALPHA2, 4)
    assert links.count() < users.count() < edges.count()
    want = bf.components([r.user_id for r in users.collect()], [(r.src, r.dst) for r in edges.collect()])
    monkeypatch.setattr(Q.G, "similar_users", None)
    got = {r.user_id: r.cluster_id for r in Q.q_user_clusters(spark, SF01).collect()}
    assert got == want == {r.user_id: r.cluster_id for r in G.connected_components(users, links).collect()}
