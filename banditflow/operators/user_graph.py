"""The user graph of the replays without its edges: components from a spanning forest.

The graph starts complete and only loses edges: two users stay linked while, in every block so far,
``||theta_u - theta_v|| <= alpha2 (f(t_u) + f(t_v))``.  Components need a spanning forest, not the edges, so
this module keeps

    history   user_id, hist: one (theta, f) a block, f the confidence radius of t
    forest    src, dst: edges of the graph, one tree a component
    labels    user_id, label: smallest user of the component

A new block tests the forest's edges only.  While none is lost the components stand (edges never come back),
and that takes three jobs.  Otherwise the trees that lost an edge look for replacements among their own users:

    stars     users of one small grid cell are tested against the cell's first user: dense groups become one
              part in one row a user
    nearby    users are tested against the first users of the neighbouring cells, at most 26 rows a user, so that
              dense groups of many cells become one part, too
    borders   cells whose neighbourhood holds one part only are done; in the others, users of the cell's main part
              meet only users around them that are not of it, all others meet all around them, inside tasks, in
              blocks, and only links that join two parts come out

Rows written are linear in the users: no edge is listed that the components do not need.  The grid lies on three
1-Lipschitz coordinates of the current theta: its first ones when d is small, distances to three far-apart
pivots otherwise.

The edges themselves follow from ``history``: ``count_edges`` counts them inside tasks without a row an edge,
``standing_edges`` lists them for who reads them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.functions import linalg as L
from banditflow.operators.graph import coordinates, radius_tier, spanning_forest
from banditflow.session import materialize, materialize_counted, release

#: Up to so many users are compared in blocks without a grid.
SMALL = 4096
#: Users of a cell that a task holds at a time; the users they meet stream by.
HELD = 512
#: Distances computed at a time.
PAIRS = 1 << 18
#: Where edges are counted: users of a cell held by a task (more where many users would be sent to many tasks), the
#: numbers they may fill, and pairs tested at a time, held by passing users.
EDGE_HELD, EDGE_NUMBERS, TILE = 8192, 1 << 21, (2048, 128)


@dataclass
class UserGraph:
    history: DataFrame
    forest: DataFrame
    labels: DataFrame
    #: forest edges lost in the last block (None: first block)
    lost: int | None = None

    @property
    def clusters(self) -> DataFrame:
        """user_id, cluster_id: the smallest user of the component."""
        return self.labels.select("user_id", F.col("label").alias("cluster_id"))


def _linked(a: Column, b: Column, alpha2: float, strict: bool) -> Column:
    """Test of one block: (theta, f) against (theta, f)."""
    dist = L.l2_distance(a["theta"], b["theta"])
    bound = F.lit(alpha2) * (a["f"] + b["f"])
    return dist < bound if strict else dist <= bound


def _always_linked(a: str, b: str, alpha2: float, strict: bool) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: _linked(x, y, alpha2, strict)), lambda ok: ok)


def _materialized(name: str, df: DataFrame) -> DataFrame:
    return materialize(df)


def refresh(
    graph: UserGraph | None, theta: DataFrame, alpha2: float, d: int, strict: bool = False,
    write: Callable[[str, DataFrame], DataFrame] = _materialized,
) -> UserGraph:
    """The graph after a block that left the users at ``theta`` (user_id, theta, t); None: the complete graph.

    ``write(name, table)`` keeps a new history, forest or labels table and gives it back as read; while no tree
    lost an edge, forest and labels of ``graph`` are handed on as they are.
    """
    now = theta.select("user_id", F.struct("theta", L.confidence_radius("t").alias("f")).alias("now"))
    if graph is None:
        history = write("history", now.select("user_id", F.array("now").alias("hist")))
        users = history.select("user_id", F.lit(0).cast("long").alias("part"), F.col("user_id").alias("frag"), "hist")
        found = find_links(users, users.count(), alpha2, d, strict)
        grown = history.select("user_id").join(found.labels.withColumnRenamed("node", "user_id"), "user_id", "left")
        labels = write("labels", grown.select("user_id", F.coalesce("label", "user_id").alias("label")))
        forest = write("forest", found.forest)
        release(*found.tables)
        return UserGraph(history, forest, labels)

    history = write(
        "history", graph.history.join(now, "user_id").select("user_id", F.concat("hist", F.array("now")).alias("hist"))
    )
    ends = history.select("user_id", F.element_at("hist", -1).alias("now"))
    tested = (
        graph.forest.join(ends.select(F.col("user_id").alias("src"), F.col("now").alias("a")), "src")
        .join(ends.select(F.col("user_id").alias("dst"), F.col("now").alias("b")), "dst")
        .select("src", "dst", _linked(F.col("a"), F.col("b"), alpha2, strict).alias("ok"))
    )
    tested = materialize(tested)
    lost = tested.where("not ok").count()
    release(graph.history)
    if not lost:
        release(tested)
        return UserGraph(history, graph.forest, graph.labels, 0)

    kept = tested.where("ok").select("src", "dst")
    torn = tested.where("not ok").join(graph.labels.withColumnRenamed("user_id", "src"), "src").select("label").distinct()
    torn = graph.labels.join(torn, "label", "left_semi")
    pieces = spanning_forest(kept.join(torn.select(F.col("user_id").alias("src")), "src", "left_semi"))
    frags = torn.join(pieces.labels.withColumnRenamed("node", "user_id").withColumnRenamed("label", "frag"), "user_id", "left")
    users = frags.select("user_id", F.col("label").alias("part"), F.coalesce("frag", "user_id").alias("frag")).join(history, "user_id")
    users, n = materialize_counted(users)
    found = find_links(users, n, alpha2, d, strict)
    # new labels: fragments joined by links; every other component keeps its own
    grown = users.select("user_id", "frag").join(found.labels.withColumnRenamed("node", "frag"), "frag", "left")
    grown = grown.select("user_id", F.coalesce("label", "frag").alias("new"))
    labels = graph.labels.join(grown, "user_id", "left").select("user_id", F.coalesce("new", "label").alias("label"))
    forest, labels = write("forest", kept.unionByName(found.forest)), write("labels", labels)
    release(graph.forest, graph.labels, users, tested, *pieces.tables, *found.tables)
    return UserGraph(history, forest, labels, lost)


def similar_links(theta: DataFrame, alpha2: float, d: int, strict: bool = False) -> DataFrame:
    """Edges (src, dst) of ``graph.similar_users`` that span its components, at most one a user: what components need.

    Every user is placed and compared as far as it may still join two components; no other edge is listed.
    """
    now = F.struct("theta", L.confidence_radius("t").alias("f"))
    users = theta.where("user_id is not null").select(
        "user_id", F.lit(0).cast("long").alias("part"), F.col("user_id").alias("frag"), F.array(now).alias("hist")
    )
    users, n = materialize_counted(users)
    return find_links(users, n, alpha2, d, strict).forest


# ------------------------------------------------------------------ links between fragments
@dataclass
class Links:
    labels: DataFrame  # node (a fragment), label (smallest fragment it is joined with)
    forest: DataFrame  # src, dst: edges between users that join fragments, without cycles
    tables: list[DataFrame]  # written tables behind both


def find_links(users: DataFrame, n: int, alpha2: float, d: int, strict: bool = False) -> Links:
    """Edges of the graph that join the fragments of each part as far as the graph joins them.

    ``users``: user_id, part, frag, hist (a written table of ``n`` rows); a fragment is named by its smallest user.
    """
    if n <= SMALL:
        return _joined(_compare(_whole(users, n), alpha2, d, strict))
    base = users.withColumn("_r", F.lit(alpha2) * F.element_at("hist", -1)["f"])
    base = coordinates(base, F.element_at("hist", -1)["theta"], d)
    r_max = base.agg(F.max("_r")).first()[0]
    base = materialize(base.withColumn("_tier", radius_tier(F.lit(r_max), F.col("_r"))).drop("_r"))
    stars, copies = _stars(base, r_max, alpha2, strict)
    first = spanning_forest(stars, "fs", "fd", ("src", "dst"))
    # a user whose whole history equals that of a smaller user of the part is linked to it and adds nothing more
    alone = base.join(copies.select("user_id"), "user_id", "left_anti")
    alone = alone.join(first.labels.withColumnRenamed("node", "frag"), "frag", "left").withColumn("frag", F.coalesce("label", "frag"))
    alone = materialize(alone.drop("label"))
    near = _nearby(alone, r_max, alpha2, strict)
    second = spanning_forest(near, "fs", "fd", ("src", "dst"))
    grown = alone.join(second.labels.withColumnRenamed("node", "frag"), "frag", "left").withColumn("frag", F.coalesce("label", "frag"))
    grown = materialize(grown.drop("label"))
    cells = _cells(grown, r_max)
    links = _compare(_borders(grown, cells, r_max), alpha2, d, strict)
    for forest in (first.forest, second.forest):
        links = links.unionByName(forest.select("src", "dst", "fs", "fd"))
    return _joined(links, [base, stars, copies, alone, near, grown, cells, *first.tables, *second.tables])


def _joined(links: DataFrame, used: Sequence[DataFrame] = ()) -> Links:
    found = spanning_forest(links, "fs", "fd", ("src", "dst"))
    return Links(found.labels, found.forest.select("src", "dst"), [*used, *found.tables])


def _cell(co: str, level: Column, r_max: float, scale: float = 2.0) -> list[Column]:
    width = F.lit(scale * r_max) * F.pow(F.lit(0.5), level)
    return [F.floor(F.element_at(co, i + 1) / width).cast("long").alias(f"c{i}") for i in range(3)]


def _stars(base: DataFrame, r_max: float, alpha2: float, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(links of users to the first user of their cell, users that repeat a smaller user's history) as tables."""
    cell = ["part", "_tier", "c0", "c1", "c2"]
    placed = base.select("user_id", "part", "frag", "hist", "_tier", *_cell("_co", F.col("_tier"), r_max, 1.0))
    centre = placed.groupBy(*cell).agg(F.min_by(F.struct("user_id", "frag", "hist"), "user_id").alias("c"))
    met = placed.join(centre, cell).where(F.col("user_id") != F.col("c.user_id"))
    stars = met.where(_always_linked("hist", "c.hist", alpha2, strict)).select(
        F.col("c.user_id").alias("src"), F.col("user_id").alias("dst"), F.col("c.frag").alias("fs"), F.col("frag").alias("fd")
    )
    same = base.groupBy("part", "hist").agg(F.min("user_id").alias("first"), F.min_by("frag", "user_id").alias("ff"), F.count(F.lit(1)).alias("n"))
    same = same.where("n > 1")
    copies = base.join(same.select("part", "hist", "first", "ff"), ["part", "hist"]).where("user_id <> first")
    copies = materialize(copies.select("user_id", "frag", "first", "ff"))
    # equal histories are at distance 0, under any bound
    twins = copies.select(F.col("first").alias("src"), F.col("user_id").alias("dst"), F.col("ff").alias("fs"), F.col("frag").alias("fd"))
    links = stars.unionByName(twins).where("fs <> fd")
    return materialize(links), copies


def _nearby(base: DataFrame, r_max: float, alpha2: float, strict: bool) -> DataFrame:
    """Links of users to the first users of the cells around their own, one for two fragments, as a table."""
    cell = ["part", "_tier", "c0", "c1", "c2"]
    placed = base.select("user_id", "part", "frag", "hist", "_tier", *_cell("_co", F.col("_tier"), r_max, 1.0))
    centre = placed.groupBy(*cell).agg(F.min_by(F.struct("user_id", "frag", "hist"), "user_id").alias("c"))
    around = _around(centre.withColumnRenamed("_tier", "lvl"), "c").withColumnRenamed("lvl", "_tier")
    met = placed.join(around, cell).where(F.col("frag") != F.col("c.frag"))
    links = met.where(_always_linked("hist", "c.hist", alpha2, strict)).select(
        F.col("c.user_id").alias("src"), F.col("user_id").alias("dst"), F.col("c.frag").alias("fs"), F.col("frag").alias("fd")
    )
    return materialize(links.groupBy("fs", "fd").agg(F.min(F.struct("src", "dst")).alias("e")).select("e.src", "e.dst", "fs", "fd"))


def _whole(users: DataFrame, n: int) -> DataFrame:
    """A few users: each part is one cell, held in chunks."""
    chunks = max(1, -(-n // HELD))
    mine = F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int")
    row = ["part", "user_id", "frag", "hist"]
    homes = users.select(*row, F.lit("").alias("cell"), mine.alias("chunk"), F.lit(0).alias("side"))
    probes = users.select(*row, F.lit("").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"))
    return homes.unionByName(probes)


AT = ["part", "lvl", "c0", "c1", "c2"]


def _around(cells: DataFrame, *keep: str) -> DataFrame:
    """Every cell moved to its 27 neighbours."""
    steps = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in itertools.product((-1, 0, 1), repeat=3)])
    moved = cells.withColumn("_o", F.explode(steps))
    return moved.select("part", "lvl", *[(F.col(f"c{i}") + F.col(f"_o.o{i}")).alias(f"c{i}") for i in range(3)], *keep)


def _placed(base: DataFrame, r_max: float) -> DataFrame:
    """Every user in its cell of each level up to its tier."""
    levels = base.select("user_id", "part", "frag", "hist", "_tier", "_co", F.explode(F.sequence(F.lit(0), F.col("_tier"))).alias("lvl"))
    return levels.select("user_id", "part", "frag", "hist", "_tier", "lvl", *_cell("_co", F.col("lvl"), r_max))


def _cells(base: DataFrame, r_max: float) -> DataFrame:
    """Border cells: users live there and more than one fragment reaches them.

    ``main``: the fragment of most users that live there, in ``mains`` chunks; the others are in ``chunks`` (0: none).
    """
    counts = _placed(base, r_max).groupBy(*AT, "frag").agg(F.sum((F.col("lvl") == F.col("_tier")).cast("long")).alias("n"))
    cells = materialize(counts.groupBy(*AT).agg(
        F.min("frag").alias("lo"), F.max("frag").alias("hi"), F.sum("n").alias("homes"),
        F.max(F.struct("n", "frag")).alias("most"),
    ))
    reach = _around(cells, "lo", "hi").groupBy(*AT).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    border = materialize(reach.where("lo < hi").join(cells.where("homes > 0").select(*AT, "homes", "most"), AT).select(
        *AT, F.concat_ws(":", "lvl", "c0", "c1", "c2").alias("cell"), F.col("most.frag").alias("main"),
        F.ceil(F.col("most.n") / HELD).cast("int").alias("mains"),
        F.ceil((F.col("homes") - F.col("most.n")) / HELD).cast("int").alias("chunks"),
    ))
    release(cells)
    return border


def _borders(base: DataFrame, border: DataFrame, r_max: float) -> DataFrame:
    """Users of the border cells, and the users around them, chunk by chunk.

    Users of a cell's main fragment lie in chunks below 0, which only users of other fragments are sent to: two users
    of one fragment have nothing to join, so a fragment that fills a cell costs a row a user there.
    """
    placed = _placed(base, r_max)
    row = ["part", "user_id", "frag", "hist", "cell", "chunk", "side"]
    dealt = F.xxhash64("user_id")
    mine = F.col("frag") == F.col("main")
    homes = placed.where("lvl = _tier").join(border, AT).withColumn(
        "chunk", F.when(mine, -1 - F.pmod(dealt, F.col("mains"))).otherwise(F.pmod(dealt, F.greatest("chunks", F.lit(1)))).cast("int")
    )
    none = F.array().cast("array<int>")
    others = F.when(F.col("chunks") > 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(none)
    mains = F.when(mine, none).otherwise(F.sequence(-F.col("mains"), F.lit(-1)))
    probes = placed.join(_around(border, "cell", "main", "mains", "chunks"), AT).withColumn("chunk", F.explode(F.concat(others, mains)))
    return homes.withColumn("side", F.lit(0)).select(row).unionByName(probes.withColumn("side", F.lit(1)).select(row))


# ------------------------------------------------------------------ comparison inside tasks
class _Parts:
    """Which fragments are joined already, within one chunk of a cell."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def roots(self, frags: np.ndarray) -> np.ndarray:
        if not self.up:
            return frags
        names, where = np.unique(frags, return_inverse=True)
        return np.array([self.find(int(x)) for x in names], dtype=np.int64)[where]


def _arrays(batch: pa.RecordBatch, rows: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
    """(ids, fragments, theta [n, blocks, d], f [n, blocks])."""
    take = batch.take(pa.array(rows))
    hist = take.column("hist").flatten()
    n = len(rows)
    theta = np.asarray(hist.field("theta").flatten(), dtype=np.float64).reshape(n, -1, d)
    f = np.asarray(hist.field("f"), dtype=np.float64).reshape(n, -1)
    return np.asarray(take.column("user_id")), np.asarray(take.column("frag")), theta, f


def _passing(h: tuple, p: tuple, need: np.ndarray, alpha2: float, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home row, probe row) among ``need`` that pass the test of every block, the newest first."""
    hi, pi = np.nonzero(need)
    for j in range(h[3].shape[1] - 1, -1, -1):
        if not len(hi):
            break
        square = np.zeros(len(hi))
        for i in range(h[2].shape[2]):  # summed in the order of the column expression
            diff = h[2][hi, j, i] - p[2][pi, j, i]
            square += diff * diff
        dist, bound = np.sqrt(square), alpha2 * (h[3][hi, j] + p[3][pi, j])
        ok = dist < bound if strict else dist <= bound
        hi, pi = hi[ok], pi[ok]
    return hi, pi


def _compare(met: DataFrame, alpha2: float, d: int, strict: bool) -> DataFrame:
    """src, dst, fs, fd: links between fragments of a part, at most one less a chunk than it has fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, parts = None, [], _Parts()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "cell", "chunk"))))
            side = np.asarray(batch.column("side"))
            out: list[tuple[int, int, int, int]] = []
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start] and side[end] == side[start]:
                    end += 1
                if keys[start] != key:
                    key, held, parts = keys[start], [], _Parts()
                rows = _arrays(batch, np.arange(start, end), d)
                if side[start] == 0:
                    held.append(rows)
                elif held:
                    if len(held) > 1:
                        held = [tuple(np.concatenate(x) for x in zip(*held))]
                    _meet(held[0], rows, parts, out)
                start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["src", "dst", "fs", "fd"])

    def _meet(h: tuple, p: tuple, parts: _Parts, out: list) -> None:
        step = max(1, PAIRS // len(h[0]))
        for at in range(0, len(p[0]), step):
            q = tuple(x[at : at + step] for x in p)
            mine, theirs = parts.roots(h[1]), parts.roots(q[1])
            need = mine[:, None] != theirs[None, :]
            if not need.any():
                continue
            hi, pi = _passing(h, q, need, alpha2, strict)
            if not len(hi):
                continue
            pairs, first = np.unique(np.stack([mine[hi], theirs[pi]], axis=1), axis=0, return_index=True)
            for (a, b), k in zip(pairs.tolist(), first.tolist()):
                a, b = parts.find(a), parts.find(b)
                if a != b:
                    parts.up[max(a, b)] = min(a, b)
                    out.append((int(h[0][hi[k]]), int(q[0][pi[k]]), int(h[1][hi[k]]), int(q[1][pi[k]])))

    keys = ["part", "cell", "chunk"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(run, "src long, dst long, fs long, fd long")


# ------------------------------------------------------------------ edges, counted or listed
def count_edges(history: DataFrame, alpha2: float, d: int, strict: bool = False) -> DataFrame:
    """One row ``n_edges``, the pairs of users linked in every block of ``history``.

    Every pair that the grid cannot rule out is tested once, in tiles inside tasks; what leaves a task is its sum.
    Rows shuffled are the users times the chunks of the cells around them; no row an edge is written.
    """
    counted = _edge_tiles(history, alpha2, d, strict, False)
    return counted.agg(F.coalesce(F.sum("n_edges"), F.lit(0)).cast("long").alias("n_edges"))


def standing_edges(history: DataFrame, alpha2: float, d: int, strict: bool = False) -> DataFrame:
    """The edges (src < dst) that ``count_edges`` counts, each a row: a quadratic number in dense groups."""
    return _edge_tiles(history, alpha2, d, strict, True)


CELL = ["lvl", "c0", "c1", "c2"]


def _edge_tiles(history: DataFrame, alpha2: float, d: int, strict: bool, listed: bool) -> DataFrame:
    """Every pair within reach meets in one task: in the cell and chunk of the user of the lower tier.

    The grid of ``graph.candidate_pairs`` on the newest vectors.  Two users of one tier meet in the cell that is later
    in the order of cells; in their own cell in the later chunk, in their own chunk among the held users.
    """
    spark = history.sparkSession
    now = F.element_at("hist", -1)
    flat = F.flatten(F.transform("hist", lambda h: F.concat(h["theta"], F.array(h["f"]))))
    base = history.where("user_id is not null").select("user_id", "hist", now["theta"].alias("theta"), (F.lit(alpha2) * now["f"]).alias("_r"))
    base = coordinates(base, F.col("theta"), d).withColumn("row", flat)
    n, r_max, wide = base.agg(F.count(F.lit(1)), F.max("_r"), F.max(F.size("row"))).first()
    r_max = 1.0 if r_max is None else r_max
    cores = spark.sparkContext.defaultParallelism
    held = max(1, min(EDGE_NUMBERS // (wide or 1), max(EDGE_HELD, -(-n // (4 * cores)))))
    base = base.select("user_id", "row", "_co", radius_tier(F.lit(r_max), F.col("_r")).alias("_tier"))
    homes = base.select("user_id", "row", F.col("_tier").alias("lvl"), *_cell("_co", F.col("_tier"), r_max))
    cells = homes.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("chunks"))
    steps = [
        F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)], F.lit((off > (0, 0, 0)) - (off < (0, 0, 0))).alias("ahead"))
        for off in itertools.product((-1, 0, 1), repeat=3)
    ]
    around = cells.withColumn("_o", F.explode(F.array(*steps))).select(
        "lvl", *[(F.col(f"c{i}") - F.col(f"_o.o{i}")).alias(f"c{i}") for i in range(3)],
        *[F.col(f"c{i}").alias(f"t{i}") for i in range(3)], "chunks", "_o.ahead",
    )
    mine = F.pmod(F.xxhash64("user_id"), F.col("chunks")).cast("int")
    levels = base.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.col("_tier"))))
    levels = levels.select("user_id", "row", "_tier", "lvl", *_cell("_co", F.col("lvl"), r_max))
    first = F.when((F.col("lvl") < F.col("_tier")) | (F.col("ahead") > 0), 0).when(F.col("ahead") == 0, mine + 1).otherwise(F.col("chunks"))
    probes = levels.join(around, CELL).withColumn("_first", first).where(F.col("_first") < F.col("chunks"))
    probes = probes.withColumn("chunk", F.explode(F.sequence(F.col("_first"), F.col("chunks") - 1)))
    met = homes.join(cells, CELL).select(*CELL, mine.alias("chunk"), F.lit(0).alias("side"), "user_id", "row").unionAll(
        probes.select("lvl", *[F.col(f"t{i}").alias(f"c{i}") for i in range(3)], "chunk", F.lit(1).alias("side"), "user_id", "row")
    )
    keys = [*CELL, "chunk"]
    # few rows, much work each: not fewer tasks than cores
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    dealt = met.repartition(spread, *keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(_tiles(keys, alpha2, d, strict, listed), "src long, dst long" if listed else "n_edges long")


class _Side:
    """Users of a tile's side, with the terms of g = |a - b|^2 - (alpha2 (f_a + f_b))^2 as a product of both sides."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], alpha2: float, d: int):
        self.ids = np.concatenate([ids for ids, _ in parts])
        rows = np.concatenate([r for _, r in parts]).reshape(len(self.ids), -1, d + 1)
        self.theta, self.f = rows[:, :, :d], rows[:, :, d]
        square, reach = (self.theta * self.theta).sum(axis=2), (alpha2 * self.f) ** 2
        self.rest, self.size, self.pull = square - reach, square + reach, -2.0 * alpha2 * alpha2 * self.f

    def held(self) -> None:
        """The left side's terms a block and the largest ones of each stretch of a tile's length."""
        ones = np.ones_like(self.f)[:, :, None]
        terms = np.concatenate((-2.0 * self.theta, self.rest[:, :, None], ones, self.pull[:, :, None]), axis=2)
        self.terms = np.ascontiguousarray(terms.transpose(1, 0, 2))
        self.most = np.maximum.reduceat(self.size, np.arange(0, len(self.ids), TILE[0]), axis=0)

    def passing(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The right side's terms a block and the largest ones, of some users."""
        ones = np.ones_like(self.f[lo:hi])[:, :, None]
        terms = np.concatenate((self.theta[lo:hi], ones, self.rest[lo:hi, :, None], self.f[lo:hi, :, None]), axis=2)
        return np.ascontiguousarray(terms.transpose(1, 2, 0)), self.size[lo:hi].max(axis=0)

    def part(self, lo: int, hi: int) -> tuple:
        return self.ids[lo:hi], None, self.theta[lo:hi], self.f[lo:hi]


def _room() -> tuple[np.ndarray, ...]:
    """g and three masks of a tile, for all tiles of a task: fresh pages for each cost far more than the products."""
    return (np.empty(TILE[0] * TILE[1]), *(np.empty(TILE[0] * TILE[1], dtype=bool) for _ in range(3)))


def _linked_tile(h: _Side, lo: int, p: _Side, at: int, right: tuple, room: tuple, alpha2: float, d: int, strict: bool) -> np.ndarray:
    """[held, passing]: the pairs of a tile that are linked in every block, tested from the newest one; a mask in ``room``.

    A pair whose g is within rounding of 0 is left to the test as it is written (``_passing``), and so are all that
    are left once they are few.
    """
    hi, end = min(lo + TILE[0], len(h.ids)), at + right[0].shape[2]
    g, ok, sure, maybe = (x[: (hi - lo) * (end - at)].reshape(hi - lo, end - at) for x in room)
    ok[:] = True

    def exact(need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _passing(h.part(lo, hi), p.part(at, end), need, alpha2, strict)

    left = ok.size
    for j in range(h.f.shape[1] - 1, -1, -1):
        scale = h.most[lo // TILE[0], j] + right[1][j]
        if left * 16 < ok.size or alpha2 < 0 or not np.isfinite(scale):
            passed = exact(ok)
            ok[:] = False
            ok[passed] = True
            return ok
        np.matmul(h.terms[j, lo:hi], right[0][j], out=g)
        slack = (8 * d + 64) * 2.0**-52 * scale + 1e-300
        np.less(g, -slack, out=sure)
        np.less_equal(g, slack, out=maybe)
        if np.count_nonzero(sure) != np.count_nonzero(maybe):
            np.greater(maybe, sure, out=maybe)
            sure[exact(maybe)] = True
        ok &= sure
        left = np.count_nonzero(ok)
    return ok


def _tiles(keys: list[str], alpha2: float, d: int, strict: bool, listed: bool):
    """Stream by (cell, chunk), held users first -> the edges among them and to passing users, or their number."""

    def meet(h: _Side, p: _Side, room: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tiles (held ids, passing ids, linked) of two sides; of one side with itself every pair once."""
        for at in range(0, len(p.ids), TILE[1]):
            end = min(at + TILE[1], len(p.ids))
            right = p.passing(at, end)
            for lo in range(0, len(h.ids), TILE[0]):
                hi = min(lo + TILE[0], len(h.ids))
                if h is p and hi <= at + 1:
                    continue
                ok = _linked_tile(h, lo, p, at, right, room, alpha2, d, strict)
                if h is p and lo < end:
                    ok &= np.arange(lo, hi)[:, None] > np.arange(at, end)[None, :]
                yield h.ids[lo:hi], p.ids[at:end], ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for a, b, ok in tiles(batches):
            if not listed:
                total += int(np.count_nonzero(ok))
                continue
            ai, bi = np.nonzero(ok)
            if len(ai):
                a, b = a[ai], b[bi]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])
        if not listed:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n_edges"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key, waiting, held, room = None, [], None, _room()

        def close() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """All held users of the key are here."""
            nonlocal waiting, held
            if waiting:
                held, waiting = _Side(waiting, alpha2, d), []
                held.held()
                yield from meet(held, held, room)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in [*keys, "side"]])
            cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                here = tuple(cols[:-1, start].tolist())
                if here != key:
                    yield from close()
                    key, held = here, None
                part = batch.slice(start, end - start)
                users = np.asarray(part.column("user_id")), np.asarray(part.column("row").flatten(), dtype=np.float64)
                if cols[-1, start] == 0:
                    waiting.append(users)
                    continue
                yield from close()
                yield from meet(held, _Side([users], alpha2, d), room)
        yield from close()

    return run
