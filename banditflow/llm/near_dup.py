"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

1. Documents with the same shingle set form a class; its smallest id stands for it.
2. Chosen paths.  In each of ``trees`` trees a node picks one or two of the 256 minwise functions (by a
   hash of its path; two at every fourth root and at half of the crowded nodes below, so a pair at the
   threshold has 1.2 common children there on average) and hands every document down to the child named by its
   minwise token.  A node of at most ``leaf`` documents is a leaf, larger ones branch again, to ``depth``;
   what is then still large is mostly one group of copies, and the next step takes leaves of any size.
3. Leaves are compared exhaustively, in two steps.  First every member with the leaf's smallest: one
   pair a row, never all pairs, so a group of thousands of copies stays linear.  Then the
   members that the links found so far have not yet joined:
   small leaves give the pairs that sizes and one-byte minwise sketches do not rule out (fewer equal bytes
   out of 256 than ``sketch_bound`` allows, which a pair at the threshold has with probability at most ``miss``), and
   those are decided on full sets; large leaves with common members (the same copies in several trees) are put
   together to a crowd, whose members meet once, with their full sets, in blocks of ``HELD`` documents inside
   tasks: what comes out are confirmed links that join two parts, never candidates.
4. Connected components of the confirmed links, and of the classes that rows of one id belong to.

The trees share the 256 functions, so their misses are not independent.  Simulated with the code below, pairs
of ideal minwise tokens that agree in each function with probability 0.8: none of 200,000
was parted in all 12 trees at each of the depths 1 to 3, and none of 100,000 at depth 4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditflow.llm.texts import LOWER, U64, WordIds, map_texts, mix64, slices, tidied, window_hashes, word_hashes
from banditflow.operators.graph import edge_components
from banditflow.session import materialize, materialize_counted, release

COORDS, SKETCHES, TREES, LEAF, DEPTH, MISS = 256, 256, 12, 128, 4, 1e-6
#: Documents of a crowd that a task holds, at most, and bytes of their sets; the others of the crowd stream by.
HELD, HELD_BYTES = 1024, 64 << 20
#: Ids (8 bytes each) that are broadcast to the texts to pick theirs.
BROADCAST_IDS = 1_000_000

_SEED = mix64(np.arange(1, 2 * SKETCHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEED[:SKETCHES], _SEED[SKETCHES:] | U64(1)
_NO_ID = -(2**63)


def shingle_set(text: bytes, n: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words are one shingle, none make an empty set."""
    h = word_hashes(text.translate(LOWER).split(), ids)
    return np.unique(window_hashes(h, min(n, len(h)) or 1))


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise token of a non-empty set under each of the SKETCHES functions (uint32)."""
    low = np.full(SKETCHES, 2**64 - 1, U64)
    for i in range(0, len(s), 512):
        np.minimum(low, ((s[i : i + 512, None] ^ _XOR) * _ODD).min(0), out=low)
    return (low >> U64(32)).astype("<u4")


def sketch_bound(percent: int, miss: float = MISS) -> int:
    """The most equal bytes that a pair at ``percent`` falls short of with probability at most ``miss``.

    Equal bytes are counted as binomial with the similarity alone; chance agreement of unequal tokens only adds to them.
    """
    p, below = min(max(percent / 100, 0.0), 1.0), 0.0
    for k in range(SKETCHES + 1):
        below += comb(SKETCHES, k) * p**k * (1 - p) ** (SKETCHES - k)
        if below > miss:
            return k
    return SKETCHES


def _children(path: np.ndarray, tokens: np.ndarray, two: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For documents at nodes ``path``: row numbers and paths of the children they go to.

    ``two``: whether the nodes have two children; by default a hash says so for half of them.
    """
    choice = mix64(path ^ U64(0x2545F4914F6CDD1D))
    rows, out = [], []
    for k in range(2):
        at = ((choice >> U64(8 + 8 * k)) % U64(COORDS)).astype(np.int64)
        also = (choice & U64(1)) == 0 if two is None else np.full(len(path), two)
        go = np.arange(len(path)) if k == 0 else np.flatnonzero(also)
        child = path[go] * U64(0xD1342543DE82EF95) + (at[go].astype(U64) << U64(32)) + tokens[go, at[go]].astype(U64)
        rows.append(go)
        out.append(mix64(child + U64(k)))
    return np.concatenate(rows), np.concatenate(out)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDS)


def _roots(trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, doc, n = _tokens(b.column("tokens")), b.column("doc").to_numpy(), b.column("n").to_numpy()
            for t in range(trees):
                root = np.full(len(doc), mix64(np.array([t + 1], U64))[0], U64)
                i, path = _children(root, tokens, two=t % 4 == 0)
                yield pa.RecordBatch.from_arrays([path.view(np.int64), doc[i], n[i]], names=["path", "doc", "n"])

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            doc, n = b.column("doc").to_numpy(), b.column("n").to_numpy()
            i, path = _children(b.column("path").to_numpy().astype(np.int64).view(U64), _tokens(b.column("tokens")))
            yield pa.RecordBatch.from_arrays([path.view(np.int64), doc[i], n[i]], names=["path", "doc", "n"])


def _leaves(sig: DataFrame, trees: int, leaf: int, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(path, doc, n, m, m_n, size): the members of every leaf with two or more, m being its smallest id; its tables."""
    kind = "path long, doc long, n long"
    rows = sig.select("doc", "n", "tokens").mapInArrow(tidied(_roots(trees)), kind)
    out, tables = None, []
    for level in range(1, depth + 1):
        rows = materialize(rows)
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "n")).alias("first"))
        sizes = sizes.where(F.col("size") > 1).select(
            "path", "size", F.col("first.doc").alias("m"), F.col("first.n").alias("m_n")
        )
        grown = materialize(rows.join(sizes, "path"))
        release(rows)
        tables.append(grown)
        done = grown if level == depth else grown.where(F.col("size") <= leaf)
        out = done if out is None else out.unionAll(done)
        large = grown.where(F.col("size") > leaf)
        if level == depth or large.isEmpty():
            break
        rows = large.select("path", "doc").join(sig.select("doc", "n", "tokens"), "doc").mapInArrow(tidied(_branch), kind)
    return out, tables


def _near(pairs: DataFrame, sig: DataFrame, sketch: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCHES) for c in ("x", "y"))
            ok = (x == y).sum(1) >= sketch
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    x = sig.select(F.col("doc").alias("a"), F.col("sketch").alias("x"))
    y = sig.select(F.col("doc").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _sets(docs: DataFrame, body: DataFrame, n: int) -> DataFrame:
    """(doc, elements), written: full shingle sets of the documents ``docs`` (doc), as sorted 64-bit hashes.

    The ids go to the texts, which stay where they are, while there are at most ``BROADCAST_IDS`` of them.
    """

    def start() -> Callable[[list], dict]:
        ids = WordIds()
        return lambda texts: {"elements": [shingle_set(t, n, ids).astype("<u8").tobytes() for t in texts]}

    wanted, k = materialize_counted(docs.select("doc").distinct())
    picked = body.join(F.broadcast(wanted) if k <= BROADCAST_IDS else wanted, "doc", "left_semi")
    sets = materialize(map_texts(picked, start, [("elements", "binary")], keep=["doc"]))
    release(wanted)
    return sets


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
    common = int((x[at] == y).sum()) if len(x) and len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common) > 0


def _confirm(pairs: DataFrame, body: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ends = pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist())
            ok = pa.array([_linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    sets = _sets(ends, body, n)
    x = sets.select(F.col("doc").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("elements").alias("y"))
    out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long"))
    release(sets)
    return out


def _mixed(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, doc, n, size, label): the members of leaves that the links so far do not join, with their labels."""
    at = leaves.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(
        "path", "doc", "n", "size", F.coalesce("label", "doc").alias("label")
    )
    mixed = at.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return at.join(mixed.select("path"), "path", "left_semi")


def _pairs(small: DataFrame, sig: DataFrame, percent: int, sketch: int) -> DataFrame:
    """Pairs inside small leaves, not yet joined, that sizes and sketches do not rule out."""
    dealt = small.select("path", "doc", "n", "label").join(sig.select("doc", "sketch"), "doc").repartition("path").sortWithinPartitions("path")

    def pairs(doc: np.ndarray, n: np.ndarray, label: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(doc), 1)
        ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        near = (sketches[i] == sketches[j]).sum(1) >= sketch
        a, b = doc[i[near]], doc[j[near]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        for b in batches:
            if not b.num_rows:
                continue
            path = b.column("path").to_numpy()
            cols = [b.column(c).to_numpy() for c in ("doc", "n", "label")]
            cols.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCHES))
            edge = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
            for lo, hi in zip(edge, edge[1:]):
                part = [c[lo:hi] for c in cols]
                if open_ is not None and open_[0] == path[lo]:
                    open_[1] = [np.concatenate(p) for p in zip(open_[1], part)]
                else:
                    if open_ is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(*open_[1])], names=["a", "b"])
                    open_ = [path[lo], part]
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(*open_[1])], names=["a", "b"])

    return dealt.mapInArrow(tidied(run), "a long, b long").distinct()


class _Joined:
    """Labels joined by the links of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def roots(self, labels: np.ndarray) -> np.ndarray:
        return labels if not self.up else np.array([self.find(int(x)) for x in labels], np.int64)


def _crowd_links(large: DataFrame, sig: DataFrame, body: DataFrame, n_words: int, percent: int, sketch: int) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed links between members of large leaves that are not yet joined; at most one less a block than
    the block has labels.

    Leaves with common members form a crowd.  Its documents are dealt into blocks of at most ``HELD`` by
    a hash; a task holds the documents of a block, compares them with each other and then with those of the later
    blocks of the crowd, which stream by.
    """
    member = large.groupBy("path").agg(F.min("doc").alias("first")).join(large.select("path", "doc"), "path")
    crowd = edge_components(member.select("first", "doc").distinct(), "first", "doc").select(F.col("node").alias("doc"), F.col("label").alias("crowd"))
    docs = large.groupBy("doc").agg(F.first("n").alias("n"), F.first("label").alias("label")).join(crowd, "doc")
    docs = materialize(docs.join(sig.select("doc", "sketch"), "doc"))
    sets = _sets(docs, body, n_words)
    sizes = docs.groupBy("crowd").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("size") / HELD), F.ceil(F.col("elements") * 8 / HELD_BYTES)).cast("int")
    full = docs.join(sizes.select("crowd", blocks.alias("blocks")), "crowd").join(sets, "doc")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    cols = ["crowd", "block", "side", "doc", "n", "label", "sketch", "elements"]
    held = full.withColumn("block", own).withColumn("side", F.lit(0)).select(cols)
    earlier = F.when(own > 0, F.sequence(F.lit(0), own - 1))
    stream = full.withColumn("block", F.explode(earlier)).withColumn("side", F.lit(1)).select(cols)
    dealt = held.unionAll(stream).repartition("crowd", "block").sortWithinPartitions("crowd", "block", "side")

    def rows_of(b: pa.RecordBatch, lo: int, hi: int) -> list:
        part = b.slice(lo, hi - lo)
        sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCHES)
        elements = [np.frombuffer(e, "<u8") for e in part.column("elements").to_pylist()]
        return [*(part.column(c).to_numpy() for c in ("doc", "n", "label")), sketches, elements]

    def meet(x: list, y: list, joined: _Joined, out: list) -> None:
        for at in range(0, len(y[0]), 32):
            d, n, label, sk = (c[at : at + 32] for c in y[:4])
            mine, theirs = joined.roots(x[2]), joined.roots(label)
            low, high = np.minimum(x[1][:, None], n), np.maximum(x[1][:, None], n)
            i, j = np.nonzero((mine[:, None] != theirs) & (100 * low >= percent * high))
            near = (x[3][i] == sk[j]).sum(1) >= sketch
            for p, q in zip(i[near].tolist(), j[near].tolist()):
                a, b = joined.find(int(mine[p])), joined.find(int(theirs[q]))
                if a != b and _linked(x[4][p], y[4][at + q], percent):
                    joined.up[max(a, b)] = min(a, b)
                    out.append((int(x[0][p]), int(d[q])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, joined = None, None, _Joined()
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("crowd", "block", "side")], 1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            for lo, hi in zip(edge, edge[1:]):
                if key is None or (keys[lo, :2] != key).any():
                    key, x, joined = keys[lo, :2], None, _Joined()
                part = rows_of(b, lo, hi)
                if keys[lo, 2] == 1:
                    if x is not None:
                        meet(x, part, joined, out)
                    continue
                if x is not None:
                    meet(x, part, joined, out)
                meet(part, part, joined, out)
                x = part if x is None else [*(np.concatenate(c) for c in zip(x[:4], part[:4])), x[4] + part[4]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return materialize(dealt.mapInArrow(tidied(run), "a long, b long")), [docs, sets]


def near_duplicates(
    docs: DataFrame, n_words: int = 5, percent: int = 80, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH,
    miss: float = MISS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    ``n_words``-word shingles (A-Z lower-cased, words split at ASCII white space; fewer words make one
    shingle).  Null, empty and blank texts have an empty set and no link.  component_id is the
    smallest doc_id reachable.  Rows that share a doc_id are one node; a null doc_id is the smallest
    id.  Repeated rows are returned as often as they come; other columns are not read.  ``miss``: with what
    probability the sketches may drop a pair right at the threshold.
    """
    sketch = sketch_bound(percent, miss)

    def start() -> Callable[[list], dict]:
        ids = WordIds()

        def work(texts: list) -> dict:
            out: dict = {"n_shingles": [], "s1": [], "s2": [], "tokens": [], "sketch": []}
            for t in texts:
                s = shingle_set(t, n_words, ids)
                with np.errstate(over="ignore"):
                    name = (s.sum(dtype=U64), mix64(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64)) if len(s) else (U64(0), U64(0))
                out["n_shingles"].append(len(s))
                out["s1"].append(int(name[0].view(np.int64)))
                out["s2"].append(int(name[1].view(np.int64)))
                tokens = minwise(s) if len(s) else None
                out["tokens"].append(None if tokens is None else tokens[:COORDS].tobytes())
                out["sketch"].append(None if tokens is None else tokens.astype(np.uint8).tobytes())
            return out

        return work

    fields = [("n_shingles", "bigint"), ("s1", "bigint"), ("s2", "bigint"), ("tokens", "binary"), ("sketch", "binary")]
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), "text")
    base = materialize(map_texts(body, start, fields, keep=["doc"]))
    classes = (
        base.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2")
        .agg(F.min("doc").alias("rep"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    )
    classes = materialize(classes)
    sig = classes.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "tokens", "sketch")

    # rows of one id are one node: the classes that an id's rows belong to are joined
    name = F.struct("n_shingles", "s1", "s2")
    several = base.where("n_shingles > 0").groupBy("doc").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low < high")
    several = base.where("n_shingles > 0").join(several.select("doc"), "doc", "left_semi").select("doc", "n_shingles", "s1", "s2")
    same_id = several.join(classes.select("n_shingles", "s1", "s2", "rep"), ["n_shingles", "s1", "s2"])
    same_id = materialize(same_id.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")).distinct())

    leaves, tables = _leaves(sig, trees, leaf, depth)
    small, great = F.least("n", "m_n"), F.greatest("n", "m_n")
    first = leaves.where((F.col("m") != F.col("doc")) & (100 * small >= percent * great))
    first = materialize(_near(first.select(F.col("m").alias("a"), F.col("doc").alias("b")).distinct(), sig, sketch))
    links = _confirm(first, body, n_words, percent).unionAll(same_id)
    labels = edge_components(links, "a", "b")
    mixed = materialize(_mixed(leaves, labels))
    large = mixed.where(F.col("size") > leaf)
    if not large.isEmpty():
        found, used = _crowd_links(large, sig, body, n_words, percent, sketch)
        links = links.unionAll(found)
        tables += used
    rest = materialize(_pairs(mixed.where(F.col("size") <= leaf), sig, percent, sketch).join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionAll(_confirm(rest, body, n_words, percent))
    labels = edge_components(links, "a", "b")
    release(first, rest, mixed, *tables)
    rep_label = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "s1", "s2", F.coalesce("label", "rep").alias("component")
    )
    # a row without words goes with the other rows of its id
    empty = base.where("n_shingles = 0").select("doc").distinct()
    by_id = base.where("n_shingles > 0").join(empty, "doc", "left_semi").join(rep_label, ["n_shingles", "s1", "s2"])
    by_id = by_id.groupBy("doc").agg(F.min("component").alias("id_component"))
    out = base.join(rep_label, ["n_shingles", "s1", "s2"], "left").join(by_id, "doc", "left")
    component = F.coalesce("component", "id_component", "doc")
    real = lambda c: F.when(c != _NO_ID, c)
    return out.select(
        real(F.col("doc")).alias("doc_id"),
        "n_shingles",
        real(component).alias("component_id"),
        (component == F.col("doc")).alias("kept"),
    )
