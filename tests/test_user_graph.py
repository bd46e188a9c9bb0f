"""Components without edges against all pairs: both routes, history, replacement of lost edges, rows written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import bruteforce as bf
from banditflow.operators import graph as G
from banditflow.operators import user_graph as U

SCHEMA = "user_id long, theta array<double>, t long"


def _table(spark, th, t):
    return spark.createDataFrame([(i, th[i].tolist(), int(t[i])) for i in range(len(t))], SCHEMA)


def _edges(th, t, alpha2, strict=False):
    f = np.sqrt((1 + np.log1p(t)) / (1 + t))
    dist = np.sqrt(((th[:, None] - th[None]) ** 2).sum(axis=2))
    bound = alpha2 * (f[:, None] + f[None])
    near = dist < bound if strict else dist <= bound
    return {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}


def _same(graph, n, edges):
    got = {r.user_id: r.cluster_id for r in graph.clusters.collect()}
    names = sorted(set(got.values()))
    assert {u: names.index(c) for u, c in got.items()} == bf.components(list(range(n)), edges)
    assert all(min(u for u, x in got.items() if x == c) == c for c in names)
    forest = [(min(r.src, r.dst), max(r.src, r.dst)) for r in graph.forest.collect()]
    assert len(forest) == n - len(names) and set(forest) <= edges


@pytest.fixture(params=["blocks", "grid"])
def route(request, monkeypatch):
    """All users in blocks, or leaders, border cells and rounds of hooking; both with few users held at a time."""
    monkeypatch.setattr(U, "HELD", 64)
    if request.param == "grid":
        monkeypatch.setattr(U, "SMALL", 0)
        monkeypatch.setattr(G, "FINISH", 0)
    return request.param


def _drift(rng, n, d, blocks, groups=3):
    """Blocks of (theta, t): groups that separate, a fifth of the users without history until block 2."""
    base = rng.normal(scale=1.2, size=(groups, d))[rng.integers(0, groups, n)]
    cold = rng.random(n) < 0.2
    for blk in range(blocks):
        t = np.where(cold & (blk < 2), 0, 30 * (blk + 1) ** 2 + rng.integers(0, 30, n))
        yield np.where((t == 0)[:, None], 0.0, base + rng.normal(scale=0.5 / (blk + 1), size=(n, d))), t


def test_blocks_of_history_equal_all_pairs(spark, route):
    rng = np.random.default_rng(1)
    graph, edges = None, None
    for th, t in _drift(rng, 160, 4, 3):
        graph = U.refresh(graph, _table(spark, th, t), 0.7, 4, strict=True)
        now = _edges(th, t, 0.7, strict=True)
        edges = now if edges is None else edges & now
        _same(graph, 160, edges)


def test_ten_prunes_equal_recomputation(spark):
    """Slowly moving users: most blocks lose no tree edge, some do, and edges that come near again stay lost."""
    rng = np.random.default_rng(3)
    n, graph, edges, lost = 120, None, None, []
    th = rng.normal(scale=0.35, size=(n, 3))
    for blk in range(11):
        t = np.full(n, 5 + 14 * blk)
        th = th + rng.normal(scale=0.02, size=(n, 3))
        graph = U.refresh(graph, _table(spark, th, t), 0.5, 3)
        now = _edges(th, t, 0.5)
        edges = now if edges is None else edges & now
        _same(graph, n, edges)
        lost.append(graph.lost)
    assert lost[0] is None and max(lost[1:]) > 0


def test_a_block_without_lost_tree_edges_takes_three_actions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 90
    th, t = rng.normal(scale=0.1, size=(n, 4)), np.full(n, 40)
    graph = U.refresh(None, _table(spark, th, t), 0.7, 4)
    tables = []
    keep = U.materialize
    monkeypatch.setattr(U, "materialize", lambda df: tables.append(1) or keep(df))
    monkeypatch.setattr(U, "find_links", None)
    again = U.refresh(graph, _table(spark, th * 0.99, t + 1), 0.7, 4)  # history and tested edges; one count
    assert again.lost == 0 and len(tables) == 2 and again.labels is graph.labels
    assert again.history.select(F.size("hist")).distinct().collect() == [(2,)]


def _written(spark, monkeypatch, n, seed=5):
    """Rows of all tables that the first block writes for n users in three dense groups, a fifth cold."""
    rng = np.random.default_rng(seed)
    base = np.array([[2.0, 0, 0, 0], [0, 2.0, 0, 0], [0, 0, 2.0, 0]])[rng.integers(0, 3, n)]
    t = np.where(rng.random(n) < 0.2, 0, 5000 + rng.integers(0, 1000, n))
    th = np.where((t == 0)[:, None], 0.0, base + rng.normal(scale=0.004, size=(n, 4)))
    rows = []
    keep = U.materialize

    def count(df):
        out = keep(df)
        rows.append(out.count())
        return out

    df = _table(spark, th, t)
    with monkeypatch.context() as m:
        m.setattr(U, "SMALL", 0)
        m.setattr(U, "materialize", count)
        m.setattr(G, "materialize", count)
        graph = U.refresh(None, df, 0.7, 4)
    _same(graph, n, _edges(th, t, 0.7))
    return sum(rows)


def test_rows_written_grow_with_the_users_not_their_pairs(spark, monkeypatch):
    few, many = _written(spark, monkeypatch, 150), _written(spark, monkeypatch, 600)
    assert many < 5 * few and many < 40 * 600  # 600 users of three dense groups have over 50,000 edges


def test_long_vectors_meet_over_pivots(spark):
    """d = 64: pivots rule out nine tenths of the pairs of clustered users, and no edge."""
    rng = np.random.default_rng(6)
    n, d = 300, 64
    th = rng.normal(scale=1.0, size=(25, d))[rng.integers(0, 25, n)] + rng.normal(scale=0.003, size=(n, d))
    t = rng.integers(3000, 9000, n)
    df = _table(spark, th, t)
    want = _edges(th, t, 0.7)
    got = {(r.src, r.dst) for r in G.similar_users(df, 0.7, d).collect()}
    assert got == want and len(want) > n
    assert G.candidate_pairs(df, 0.7, d).count() < n * (n - 1) / 2 / 10
    _same(U.refresh(None, df, 0.7, d), n, want)


def test_users_alone_equal_and_none(spark, route):
    alone = np.eye(6)[:5] * 9.0
    _same(U.refresh(None, _table(spark, alone, np.full(5, 500)), 0.7, 6), 5, set())
    equal = np.ones((40, 2))
    _same(U.refresh(None, _table(spark, equal, np.full(40, 500)), 0.7, 2), 40, _edges(equal, np.full(40, 500), 0.7))
    if route == "blocks":
        none = U.refresh(None, spark.createDataFrame([], SCHEMA), 0.7, 2)
        assert none.clusters.count() == 0 and none.forest.count() == 0


def test_replay_clusters_equal_all_pairs(spark):
    """R1 with and without listed edges: the same cluster counts block by block."""
    from banditflow.config import ReplayConfig
    from banditflow.plans.two_stage import two_stage_replay
    from banditflow.sources import fixtures as fx
    from conftest import SF001

    log = fx.bandit_log(spark, SF001)
    cfg = ReplayConfig(iteration_length=300, mean_over="members", alpha2=0.3)
    free = two_stage_replay(log, cfg, fx.K, fx.D)
    listed = two_stage_replay(log, cfg.with_(list_edges=True), fx.K, fx.D)
    n = [(r.block, r.n_clusters) for r in free.cluster_counts.orderBy("block").collect()]
    assert n == [(r.block, r.n_clusters) for r in listed.cluster_counts.orderBy("block").collect()]
    by_edges = G.connected_components(log.select("user_id").distinct(), listed.edges)
    assert sorted(map(tuple, by_edges.collect())) == sorted(map(tuple, free.clusters.collect()))


def test_a_dense_area_of_many_cells_does_not_meet_itself(spark, monkeypatch):
    """Users spread evenly over many cells, and a few at their rim: rows sent to the comparison grow with the few."""
    rng = np.random.default_rng(8)
    n = 600
    th = np.concatenate((rng.random((n - 3, 2)), [[1.9, 0.5], [2.1, 0.5], [0.5, -0.9]]))
    t = np.append(np.full(n - 3, 50), [200, 200, 300])
    met = []
    compare = U._compare
    monkeypatch.setattr(U, "SMALL", 0)
    monkeypatch.setattr(U, "HELD", 32)
    monkeypatch.setattr(U, "_compare", lambda df, *a: met.append(df.count()) or compare(df, *a))
    _same(U.refresh(None, _table(spark, th, t), 0.7, 2), n, _edges(th, t, 0.7))
    assert len(met) == 1 and met[0] < 2 * n


# ------------------------------------------------------------------ edges counted without a row an edge
def _history(spark, blocks):
    """(history, [users, users] linked in every block at alpha2 = 0.7, the same with strict bounds)."""
    ok = {False: True, True: True}
    hist = []
    for th, t in blocks:
        f = np.sqrt((1 + np.log1p(t)) / (1 + t))
        square = sum((th[:, None, i] - th[None, :, i]) ** 2 for i in range(th.shape[1]))
        dist, bound = np.sqrt(square), 0.7 * (f[:, None] + f[None])
        ok = {False: ok[False] & (dist <= bound), True: ok[True] & (dist < bound)}
        hist.append((th, f))
    rows = [(i, [(th[i].tolist(), float(f[i])) for th, f in hist]) for i in range(len(hist[0][1]))]
    return spark.createDataFrame(rows, "user_id long, hist array<struct<theta array<double>, f double>>"), ok[False], ok[True]


def _check_edges(df, want, d, strict=False):
    want = np.triu(want, 1)
    assert [tuple(r) for r in U.count_edges(df, 0.7, d, strict).collect()] == [(int(want.sum()),)]
    got = U.standing_edges(df, 0.7, d, strict).collect()
    assert len(got) == want.sum() and {(r.src, r.dst) for r in got} == set(zip(*(x.tolist() for x in np.nonzero(want))))


@pytest.mark.parametrize("held", [40, 8192])
def test_counted_edges_are_all_pairs_of_all_blocks(spark, monkeypatch, held):
    """Radius tiers from no history to a long one, cells of several chunks, one to four blocks, vectors compared by pivots."""
    monkeypatch.setattr(U, "EDGE_HELD", held)
    rng = np.random.default_rng(11)
    blocks = list(_drift(rng, 400, 4, 4))
    blocks[-1] = (blocks[-1][0], np.where(rng.random(400) < 0.3, 10 ** rng.integers(0, 6, 400), blocks[-1][1]))
    for upto in (1, 2, 4):
        df, want, _ = _history(spark, blocks[:upto])
        _check_edges(df, want, 4)
    long = rng.normal(size=(20, 12))[rng.integers(0, 20, 250)] + rng.normal(scale=0.05, size=(250, 12))
    df, want, _ = _history(spark, [(long, rng.integers(5, 9000, 250))])
    assert want.sum() > 250
    _check_edges(df, want, 12)


def test_counted_edges_of_a_dense_cell_of_many_tiles(spark):
    """More users of one cell than a tile holds, most of them linked, then fewer, then few."""
    n = 2 * U.TILE[0] + 77
    rng = np.random.default_rng(12)
    base = rng.normal(scale=0.2, size=(n, 3))
    blocks = [(base, np.full(n, 16)), (base * 2, np.full(n, 40)), (base * 6, np.full(n, 90))]
    for upto in (1, 2, 3):
        df, want, _ = _history(spark, blocks[:upto])
        assert U.count_edges(df, 0.7, 3).first()[0] == np.triu(want, 1).sum()


def test_counted_edges_at_the_bound(spark):
    """Pairs exactly at the bound, equal users, vectors far from 0: the test as written decides."""
    step = 0.7 * (1.0 + 1.0)  # t = 0: f = 1
    grid = np.array([[i * step, j * step] for i in range(12) for j in range(12)] + [[0.0, 0.0]] * 3)
    for shift in (0.0, 1e6):
        df, loose, strict = _history(spark, [(grid + shift, np.zeros(len(grid)))])
        assert np.triu(loose, 1).sum() > np.triu(strict, 1).sum() or shift
        _check_edges(df, loose, 2)
        _check_edges(df, strict, 2, strict=True)
    odd = grid.copy()
    odd[5] = np.nan
    df, want, _ = _history(spark, [(odd, np.zeros(len(grid)))])
    _check_edges(df, want, 2)


def test_counted_edges_of_none_one_and_unknown_users(spark):
    none = spark.createDataFrame([], "user_id long, hist array<struct<theta array<double>, f double>>")
    assert U.count_edges(none, 0.7, 2).first()[0] == 0 and U.standing_edges(none, 0.7, 2).count() == 0
    one = spark.createDataFrame([(1, [([0.0, 0.0], 1.0)]), (None, [([0.0, 0.0], 0.5)])], none.schema)
    assert U.count_edges(one, 0.7, 2).first()[0] == 0


def test_replay_counts_edges_and_writes_none(spark, monkeypatch):
    """R1 asked for edges: their number block by block is that of the listed ones, and no written table has a row an edge."""
    from banditflow.config import ReplayConfig
    from banditflow.plans import blocks as B
    from banditflow.plans import two_stage as TS

    rng = np.random.default_rng(13)
    users, rounds = 120, 960
    rows = [(i, int(rng.integers(0, users)), rng.random((2, 2)).tolist(), rng.integers(0, 2, 2).astype(float).tolist()) for i in range(rounds)]
    log = spark.createDataFrame(rows, "round_id long, user_id long, arms array<array<double>>, rewards array<double>")
    thetas, sizes = [], {}
    keep, theta_of = B.BlockTables.write, TS.user_theta

    def write(self, name, df, blk=None, parts=()):
        out = keep(self, name, df, blk, parts)
        sizes[name, blk] = out.count()
        return out

    def seen(state, d):
        thetas.append(sorted(tuple(r) for r in theta_of(state, d).select("user_id", "theta", "t").collect()))
        return theta_of(state, d)

    monkeypatch.setattr(B.BlockTables, "write", write)
    monkeypatch.setattr(TS, "user_theta", seen)
    got = TS.two_stage_replay(log, ReplayConfig(iteration_length=320, mean_over="members", list_edges=True), 2, 2)
    edges, counts = None, []
    for rows in thetas:
        ids = [r[0] for r in rows]
        now = {(ids[a], ids[b]) for a, b in _edges(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), 0.7)}
        edges = now if edges is None else edges & now
        counts.append(len(edges))
    assert [(r.block, r.n_edges) for r in got.cluster_counts.orderBy("block").collect()] == list(enumerate(counts))
    assert len(counts) == 3 and counts[0] > counts[2] > users
    assert {(r.src, r.dst) for r in got.edges.collect()} == edges
    assert all(n <= users for (name, _), n in sizes.items() if name not in ("log", "user", "cluster"))
