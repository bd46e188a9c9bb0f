"""Prefix trie of conversations as a z-fast trie kept in tables.

Every conversation is a sequence of turns; a prefix is known by its depth and a 122-bit polynomial hash.
Branching and ending points are the compacted nodes; the edge above a node, from depth ``lo`` to ``hi``, is
kept on the path of one conversation (``rep``) and hashed at its handle: the two-fattest depth in (lo, hi].

    locate   fat binary search: each waiting conversation probes the handles at the two-fattest depth of
             the interval its exit lies in, a join a step, log2(depth) steps; then the exit edge is compared
    insert   in batches: of the conversations that leave the trie at one point with one next turn, the one of
             least hash goes in as a new path (edges that it leaves half-way are cut); those that end
             in the trie are done; the rest waits for the next batch
    expand   counts of members, leaves and tokens go up the compacted nodes, last batch first, then every
             edge is spread over the depths it stands for

Paths are drawn by hash, so a waiting group shrinks by half or more in expectation with each batch: about
log2(conversations) batches whatever the shape.  Tables are joined, never collected; a conversation of any length
is numbered and hashed in range partitions (partial hashes are put together), and only one value a
partition is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditflow.operators.ordering import key_index
from banditflow.session import materialize, release

#: Mersenne prime of both prefix hashes, and their bases.
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)
#: Depths of an edge that one row is spread over at a time; search steps between written tables.
SPREAD = 4096
STEPS_A_TABLE = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

PREFIXES = "conv long, d long, pa long, pb long, chars long, sum long"


# ------------------------------------------------------------------ conversations to prefixes
def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), ta, tb (hashes of role and text), chars (code points of the text).

    Turns by number, null first; turns of one number in the order of their hashes.  A null role or text is
    empty; rows without a conversation id take no part.
    """
    name, words = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    narrow = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").isNotNull().alias("_known"),
        F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(0)).alias("_turn"),
        F.xxhash64(name, words).alias("ta"), F.xxhash64(words, F.lit(1), name).alias("tb"),
        F.char_length(words).cast("long").alias("chars"),
    )
    numbered = key_index(narrow, "conv", ["_known", "_turn", "ta", "tb"], "pos")
    return numbered.select("conv", (F.col("pos") + 1).alias("pos"), "ta", "tb", "chars")


def with_shared_openings(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations rebuilt from the first turns of their group's first one: conv, d, ta, tb, chars.

    Conversation c takes the first h turns of conversation c - c % ``group`` (fewer if it has fewer, none if
    there is none), h = crc32(decimal c) % ``heads``, then its own turns after its first h.
    """
    base = F.col("conv") - F.pmod("conv", F.lit(group))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    opening = materialize(turns.where((F.pmod("conv", F.lit(group)) == 0) & (F.col("pos") < heads)))
    sizes = opening.groupBy(F.col("conv").alias("base")).agg(F.max("pos").alias("n"))
    ids = turns.select("conv").distinct().select("conv", base.alias("base"), h.alias("h"))
    first = ids.join(opening.withColumnRenamed("conv", "base"), "base").where("pos <= h")
    own = turns.where(F.col("pos") > h).withColumn("base", base).join(sizes, "base", "left")
    depth = F.col("pos") - h + F.least(h, F.coalesce("n", F.lit(0)))
    return first.select("conv", F.col("pos").alias("d"), "ta", "tb", "chars").unionByName(
        own.select("conv", depth.alias("d"), "ta", "tb", "chars")
    )


def _local_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, a, b, n, total = None, 0, 0, 0, 0
    for batch in batches:
        cols = batch.to_pydict()
        out_a, out_b, out_n, out_sum = [], [], [], []
        for c, ta, tb, chars in zip(cols["conv"], cols["ta"], cols["tb"], cols["chars"]):
            if c != conv:
                conv, a, b, n, total = c, 0, 0, 0, 0
            a, b, n, total = (a * BASES[0] + ta) % PRIME, (b * BASES[1] + tb) % PRIME, n + 1, total + chars
            out_a.append(a)
            out_b.append(b)
            out_n.append(n)
            out_sum.append(total)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("d"), pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()),
             batch.column("chars"), pa.array(out_sum, pa.int64()), pa.array(out_n, pa.int64()), batch.column("pid")],
            names=["conv", "d", "pa", "pb", "chars", "sum", "n", "pid"],
        )


def _joined(a: int, b: int, n: int, later_a: int, later_b: int) -> tuple[int, int]:
    """Hashes of a sequence followed by one of ``n`` turns."""
    return (a * pow(BASES[0], n, PRIME) + later_a) % PRIME, (b * pow(BASES[1], n, PRIME) + later_b) % PRIME


def _before(pieces: pd.DataFrame) -> pd.DataFrame:
    """What lies before each of a conversation's pieces (one a partition)."""
    a = b = total = 0
    out = []
    for p in pieces.sort_values("pid").itertuples():
        out.append((p.conv, p.pid, a, b, total))
        a, b = _joined(a, b, int(p.n), int(p.pa), int(p.pb))
        total += int(p.sum)
    return pd.DataFrame(out, columns=["conv", "pid", "oa", "ob", "osum"])


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = batch.to_pydict()
        hashes = [
            (x, y) if oa is None else _joined(oa, ob, n, x, y)
            for x, y, n, oa, ob in zip(cols["pa"], cols["pb"], cols["n"], cols["oa"], cols["ob"])
        ]
        sums = [s + (o or 0) for s, o in zip(cols["sum"], cols["osum"])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("d"), pa.array([h[0] for h in hashes], pa.int64()),
             pa.array([h[1] for h in hashes], pa.int64()), batch.column("chars"), pa.array(sums, pa.int64())],
            names=["conv", "d", "pa", "pb", "chars", "sum"],
        )


def prefixes(steps: DataFrame) -> DataFrame:
    """conv, d, pa, pb (hash of the first d turns), chars (of turn d), sum (chars of the first d turns).

    ``steps``: conv, d (1, 2, ... in each conversation), ta, tb, chars.
    """
    parted = steps.select("conv", "d", "ta", "tb", "chars").repartitionByRange("conv", "d").sortWithinPartitions("conv", "d")
    parted = parted.withColumn("pid", F.spark_partition_id())
    local = materialize(parted.mapInArrow(_local_hashes, PREFIXES + ", n long, pid int"))
    last = local.groupBy("conv", "pid").agg(F.max_by(F.struct("pa", "pb", "sum", "n"), "n").alias("p")).select("conv", "pid", "p.*")
    # a conversation has several pieces only where partitions meet: at most one more piece a partition
    cut = last.groupBy("conv").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("conv")
    offsets = last.join(cut, "conv", "left_semi").groupBy("conv").applyInPandas(
        _before, "conv long, pid int, oa long, ob long, osum long"
    ).where("oa <> 0 or ob <> 0 or osum <> 0")
    out = materialize(local.join(F.broadcast(offsets), ["conv", "pid"], "left").mapInArrow(_shift, PREFIXES))
    release(local)
    return out


# ------------------------------------------------------------------ the trie
EDGES = ["rep", "lo", "hi", "round", "f", "ha", "hb", "xa", "xb"]


def _fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the greatest power of two divides; null where there is none."""
    shift = f"cast(length(bin({low} ^ {high})) - 1 as int)"
    return F.expr(f"case when {low} < {high} then shiftleft(shiftright({high}, {shift}), {shift}) end")


def _lookup(df: DataFrame, table: DataFrame, conv: str, depth: Column, a: str, b: str) -> DataFrame:
    """Adds the hash of the first ``depth`` turns of ``conv`` as columns a, b (null beyond its end)."""
    at = table.select(F.col("conv").alias("_conv"), F.col("d").alias("_d"), F.col("pa").alias(a), F.col("pb").alias(b))
    return df.withColumn("_at", depth).join(at, (F.col(conv) == F.col("_conv")) & (F.col("_at") == F.col("_d")), "left").drop("_conv", "_d", "_at")


def _with_hashes(edges: DataFrame, table: DataFrame) -> DataFrame:
    """rep, lo, hi, round with handle depth f, its hash, and the hash one turn below lo."""
    edges = edges.withColumn("f", _fattest("lo", "hi"))
    edges = _lookup(edges, table, "rep", F.col("f"), "ha", "hb")
    return _lookup(edges, table, "rep", F.col("lo") + 1, "xa", "xb").select(EDGES)


def _locate(waiting: DataFrame, edges: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """Exit edge of each waiting conversation: adds xrep, xlo, xhi, xround (null: it exits at its node m) and
    g, a depth down to which it agrees with the trie."""
    at = waiting.select("*", F.col("m").alias("a"), F.col("size").alias("b"),
                        *[F.lit(None).cast("long").alias(c) for c in ("xrep", "xlo", "xhi", "xround")], F.col("m").alias("g"))
    handle = edges.select(*[F.col(c).alias("_" + c) for c in ("rep", "lo", "hi", "round", "f", "ha", "hb")])
    hit = F.col("_rep").isNotNull()
    for step in range(longest.bit_length() + 1):
        at = _lookup(at.withColumn("f", _fattest("a", "b")), table, "conv", F.col("f"), "pa", "pb")
        at = at.join(handle, (F.col("f") == F.col("_f")) & (F.col("pa") == F.col("_ha")) & (F.col("pb") == F.col("_hb")), "left")
        at = at.select(
            *waiting.columns, F.when(hit, F.col("_hi")).otherwise(F.col("a")).alias("a"),
            F.when(~hit & F.col("f").isNotNull(), F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            *[F.coalesce("_" + c, "x" + c).alias("x" + c) for c in ("rep", "lo", "hi", "round")],
            F.coalesce("_f", "g").alias("g"),
        )
        if (step + 1) % STEPS_A_TABLE == 0:
            at = materialize(at)
    # below the last hit: the child that the next turn names, whose handle may lie beyond the exit
    at = _lookup(at, table, "conv", F.coalesce("xhi", "m") + 1, "ca", "cb")
    child = edges.select(*[F.col(c).alias("_" + c) for c in ("rep", "lo", "hi", "round", "xa", "xb")])
    at = at.join(child, (F.coalesce("xhi", "m") == F.col("_lo")) & (F.col("ca") == F.col("_xa")) & (F.col("cb") == F.col("_xb")), "left")
    return at.select(
        *waiting.columns, *[F.coalesce("_" + c, "x" + c).alias("x" + c) for c in ("rep", "lo", "hi", "round")],
        F.when(hit, F.col("_lo") + 1).otherwise(F.col("g")).alias("g"),
    )


def _compare(located: DataFrame, table: DataFrame) -> DataFrame:
    """g becomes the length of the longest prefix in the trie: the exit edge is compared below the known g."""
    end = F.least("xhi", "size")
    open_ = located.where((F.col("g") < end)).select("conv", "xrep", "g", end.alias("end"))
    mine = open_.join(table.select("conv", "d", "pa", "pb"), "conv").where("d > g and d <= end")
    theirs = table.select(F.col("conv").alias("xrep"), "d", "pa", "pb")
    # hashes of prefixes agree down to the exit and nowhere below
    same = mine.join(theirs, ["xrep", "d", "pa", "pb"]).groupBy("conv").agg(F.count(F.lit(1)).alias("more"))
    return located.join(same, "conv", "left").withColumn("g", F.col("g") + F.coalesce("more", F.lit(0))).drop("more")


def _cut(edges: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges left as they are, and the pieces of those cut at (rep, lo, hi, round, at)."""
    whole = cuts.select("rep", "lo").distinct()
    ends = cuts.unionByName(cuts.select("rep", "lo", "hi", "round").distinct().withColumn("at", F.col("hi")))
    w = Window.partitionBy("rep", "lo").orderBy("at")
    pieces = ends.select("rep", F.coalesce(F.lag("at").over(w), "lo").alias("lo"), F.col("at").alias("hi"), "round")
    return edges.join(whole, ["rep", "lo"], "left_anti"), pieces


def build(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The compacted trie over ``prefixes``: (edges, paths, ends, batches).

    edges: rep, lo, hi, round and hashes; paths: rep, start, prep (path it hangs from, null for the root), pround,
    round; ends: conv, rep, hi (the node where each conversation ends).
    """
    sizes = table.groupBy("conv").agg(F.max("d").alias("size"))
    waiting = materialize(sizes.select("conv", "size", *[F.lit(v).cast("long").alias(c) for c, v in (("m", 0), ("mrep", None), ("mround", 0))]))
    edges, paths, ends, batch = None, [], [], 0
    while True:
        longest = waiting.agg(F.max(F.col("size") - F.col("m"))).first()[0]
        if longest is None:
            break
        batch += 1
        if edges is None:
            found = waiting.select("*", *[F.lit(None).cast("long").alias(c) for c in ("xrep", "xlo", "xhi", "xround")], F.col("m").alias("g"))
        else:
            found = _compare(materialize(_locate(waiting, edges, table, longest)), table)
        found = _lookup(found, table, "conv", F.col("g") + 1, "na", "nb")
        found = materialize(found.select(
            "conv", "size", "g", "na", "nb", "xrep", "xlo", "xhi", "xround",
            F.coalesce("xrep", "mrep").alias("prep"), F.coalesce("xround", "mround").alias("pround"),
        ))
        drawn = F.struct(F.xxhash64("conv").alias("draw"), *[F.col(c) for c in found.columns])
        new = materialize(found.where("g < size").groupBy("g", "na", "nb").agg(F.min(drawn).alias("w")).select("w.*"))
        done = found.where("g = size")
        ends.append(done.select("conv", F.col("prep").alias("rep"), F.col("g").alias("hi")))
        ends.append(new.select("conv", F.col("conv").alias("rep"), F.col("size").alias("hi")))
        paths.append(new.select(F.col("conv").alias("rep"), F.col("g").alias("start"), "prep", "pround", F.lit(batch).cast("long").alias("round")))
        fresh = new.select(F.col("conv").alias("rep"), F.col("g").alias("lo"), F.col("size").alias("hi"), F.lit(batch).cast("long").alias("round"))
        if edges is None:
            after = materialize(_with_hashes(fresh, table))
        else:
            inside = done.select("xrep", "xlo", "xhi", "xround", "g").unionByName(new.select("xrep", "xlo", "xhi", "xround", "g"))
            cuts = inside.where("xlo < g and g < xhi").distinct().toDF("rep", "lo", "hi", "round", "at")
            kept, pieces = _cut(edges, materialize(cuts))
            after = materialize(kept.unionByName(_with_hashes(pieces.unionByName(fresh), table)))
            release(edges)
        edges = after
        left = found.where("g < size").join(new.select("conv"), "conv", "left_anti")
        rest = materialize(left.select("conv", "size", F.col("g").alias("m"), F.col("prep").alias("mrep"), F.col("pround").alias("mround")))
        release(waiting)
        waiting = rest
    spark = table.sparkSession
    if edges is None:
        edges = spark.createDataFrame([], ", ".join(f"{c} long" for c in EDGES))
        return edges, spark.createDataFrame([], "rep long, start long, prep long, pround long, round long"), spark.createDataFrame([], "conv long, rep long, hi long"), 0
    return edges, _all(paths), _all(ends), batch


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return materialize(out)


# ------------------------------------------------------------------ facts of nodes
def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least id and digest of the comma-joined ids of each node, ids streaming by in order."""
    node, n, least, digest, out = None, 0, None, None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=["rep", "hi", "n_ends", "first", "sha"]
        )

    for batch in batches:
        cols = batch.to_pydict()
        for rep, hi, conv in zip(cols["rep"], cols["hi"], cols["conv"]):
            if digest is not None and (rep, hi) == node:
                digest.update(b",%d" % conv)
                n += 1
                continue
            if digest is not None:
                out.append((*node, n, least, digest.hexdigest()))
            node, n, least, digest = (rep, hi), 1, conv, hashlib.sha256(b"%d" % conv)
        if len(out) > 5000:
            yield flush()
            out.clear()
    if digest is not None:
        out.append((*node, n, least, digest.hexdigest()))
    if out:
        yield flush()


def _ended(ends: DataFrame) -> DataFrame:
    order = ["rep", "hi", "conv"]
    return ends.select(order).repartition("rep", "hi").sortWithinPartitions(*order).mapInArrow(
        _end_lists, "rep long, hi long, n_ends long, first long, sha string"
    )


HUNG = "prep long, start long, pround long, n long, first long, leaves long, saved long"


def _upward(edges: DataFrame, paths: DataFrame, ended: DataFrame, table: DataFrame, batches: int) -> tuple[DataFrame, DataFrame]:
    """(edges with n, first, leaves, saved, kids, parent of their top node; totals of the paths), last batch first."""
    top = table.select(F.col("conv").alias("rep"), F.col("d").alias("lo"), F.col("sum").alias("sum_lo"))
    low = table.select(F.col("conv").alias("rep"), F.col("d").alias("hi"), F.col("sum").alias("sum_hi"))
    own = edges.select("rep", "lo", "hi", "round").join(low, ["rep", "hi"]).join(top, ["rep", "lo"], "left")
    own = own.join(ended, ["rep", "hi"], "left").join(paths.select("rep", "start", "prep", "pround"), "rep")
    own = materialize(own.withColumn("sum_lo", F.coalesce("sum_lo", F.lit(0))))
    totals = table.sparkSession.createDataFrame([], HUNG)
    out = []
    below = Window.partitionBy("rep").orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("rep").orderBy("hi")
    for batch in range(batches, 0, -1):
        hung = totals.where(F.col("pround") == batch).groupBy(F.col("prep").alias("rep"), F.col("start").alias("hi")).agg(
            F.count(F.lit(1)).alias("h_kids"), F.sum("n").alias("h_n"), F.min("first").alias("h_first"),
            F.sum("leaves").alias("h_leaves"), F.sum("saved").alias("h_saved"),
        )
        zero = F.lit(0)
        e = own.where(F.col("round") == batch).join(hung, ["rep", "hi"], "left")
        more = F.lead("hi").over(along).isNotNull().cast("long")
        e = e.withColumn("kids", F.coalesce("h_kids", zero) + more)
        e = e.select(
            "*", F.sum(F.coalesce("n_ends", zero) + F.coalesce("h_n", zero)).over(below).alias("n"),
            F.min(F.least("first", "h_first")).over(below).alias("least"),
            F.sum(F.coalesce("h_leaves", zero) + (F.col("kids") == 0).cast("long")).over(below).alias("leaves"),
        )
        e = e.withColumn(
            "saved",
            F.sum((F.col("n") - 1) * (F.col("sum_hi") - F.col("sum_lo")) + F.coalesce("h_saved", zero)).over(below),
        ).withColumn("above", F.lag("least").over(along))
        e = materialize(e.drop("h_kids", "h_n", "h_first", "h_leaves", "h_saved"))
        out.append(e)
        whole = e.where("lo = start").select("prep", "start", "pround", "n", F.col("least").alias("first"), "leaves", "saved")
        totals = materialize(totals.unionByName(whole))
    release(own)
    done = out[0] if out else None
    for e in out[1:]:
        done = done.unionByName(e)
    return done, totals


def prefix_nodes(steps: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a node of the trie of all conversations: depth and text prefix are those of its least member.

    ``steps``: conv, d, ta, tb, chars (see ``prefixes``); ``ids``: conv of all conversations, those without turns
    too.  Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over
    the node and all below: (n_convs - 1) times the code points of its last text), ends_sha256 (of the
    comma-joined ids of the members that end there).  Without conversations there is no node, not even a root.
    """
    table = prefixes(steps)
    ids = materialize((table if ids is None else ids).select("conv").distinct())
    edges, paths, ends, batches = build(table)
    bare = ids.join(table.select("conv").distinct(), "conv", "left_anti")
    bare = bare.select("conv", F.lit(None).cast("long").alias("rep"), F.lit(0).cast("long").alias("hi"))
    ended = materialize(_ended(ends.unionByName(bare)))
    n_convs, least = ids.agg(F.count(F.lit(1)), F.min("conv")).first()
    done, totals = _upward(edges, paths, ended.where("rep is not null"), table, batches)
    kids, leaves, saved = totals.where("start = 0").agg(F.count(F.lit(1)), F.sum("leaves"), F.sum("saved")).first()
    at_root = ended.where("rep is null").agg(F.max("sha")).first()[0]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = ", ".join(f"{c} {'string' if c == columns[-1] else 'long'}" for c in columns)
    top = (least, 0, None, n_convs, kids, max(leaves or 0, 1), saved or 0, at_root or EMPTY_SHA)
    root = table.sparkSession.createDataFrame([top] if n_convs else [], kinds)
    if done is None:
        return root
    # the node above each path's first edge
    hooks = done.select(F.col("rep").alias("prep"), F.col("hi").alias("start"), F.col("least").alias("hook"))
    done = done.join(hooks, ["prep", "start"], "left")
    above = F.coalesce("above", F.when(F.col("prep").isNull(), F.lit(least)).otherwise(F.col("hook")))
    done = done.withColumn("top", above).select(
        "rep", "lo", "hi", "least", "top", "n", "kids", "leaves", "saved", "sum_lo", "sha",
        F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(SPREAD).cast("long"))).alias("from"),
    )
    depths = done.select(
        "*", F.explode(F.sequence(F.col("from") + 1, F.least("hi", F.col("from") + SPREAD))).alias("d")
    ).join(table.select(F.col("conv").alias("rep"), "d", "chars", "sum"), ["rep", "d"])
    last = F.col("d") == F.col("hi")
    nodes = depths.select(
        "least", "d", F.when(F.col("d") == F.col("lo") + 1, F.col("top")).otherwise(F.col("least")), "n",
        F.when(last, F.col("kids")).otherwise(F.lit(1).cast("long")), "leaves",
        F.col("saved") - (F.col("n") - 1) * (F.col("sum") - F.col("chars") - F.col("sum_lo")),
        F.when(last, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(F.lit(EMPTY_SHA)),
    ).toDF(*columns)
    return root.unionByName(nodes)
