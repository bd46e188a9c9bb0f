"""Benchmark decontamination: windows of benchmark words searched in whole training texts.

The benchmark's windows go to every executor as a hash set while the benchmark has at most
``broadcast_words`` words: sorted hashes, offsets and word numbers in arrays that the driver makes once
(about 30 bytes a benchmark word) and every worker process unpacks once.  A larger benchmark is joined by a shuffle on
64-bit hashes of the windows instead, and survivors are verified on their words.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.llm.texts import LOWER, U64, map_texts, mix64, row_key, window_hashes

WINDOW = 10
BROADCAST_WORDS = 2_000_000

#: Lower-case A-Z; every ASCII byte that is no digit or letter separates words.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class _Numbers(dict):
    """word -> its number; -1 for a word that no item has."""

    def __missing__(self, word: bytes) -> int:
        return -1


def build_index(items: list[tuple[str, bytes]], n: int) -> dict:
    """Arrays of the windows of all items: ``n`` consecutive words each; a shorter item is one window.

    names of the items, their words (joined by spaces) and the words' numbers, item after item; by window
    length the sorted hashes with the item and the first word of each window.
    """
    numbers: dict[bytes, int] = {}
    names, ids, first, lengths = sorted({i for i, _ in items}), [], [], []
    rank = {name: k for k, name in enumerate(names)}
    owner: list[int] = []
    total = 0
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        owner.append(rank[item])
        first.append(total)
        lengths.append(len(words))
        total += len(words)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    code = mix64(np.arange(1, len(numbers) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    windows: dict[int, list] = {}
    for k, at, size in zip(owner, first, lengths):
        length = min(n, size)
        h = window_hashes(code[flat[at : at + size]], length)
        windows.setdefault(length, []).append((h, np.full(len(h), k, np.int32), np.arange(at, at + len(h), dtype=np.int32)))
    packed = {}
    for length, parts in windows.items():
        h, item, start = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        packed[length] = (h[order], item[order], start[order])
    return {"names": names, "words": b" ".join(numbers), "ids": flat, "windows": packed}


class WindowIndex:
    """The unpacked arrays of ``build_index`` in a worker."""

    def __init__(self, packed: dict):
        self.names, self.ids, self.windows = packed["names"], packed["ids"], packed["windows"]
        self.numbers = _Numbers((w, i) for i, w in enumerate(packed["words"].split()))
        self.code = mix64(np.arange(1, len(self.numbers) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Mask of the words inside occurrences, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        known = ids >= 0
        if not known.any():
            return hit, items
        # runs of known words only: the rest of the text cannot match
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            run = self.code[ids[lo:hi]]
            for k, (hashes, item, start) in self.windows.items():
                if hi - lo < k:
                    continue
                h = window_hashes(run, k)
                at, end = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for i in np.flatnonzero(end > at).tolist():
                    mine = ids[lo + i : lo + i + k]
                    for j in range(at[i], end[i]):  # verified on the words
                        if (self.ids[start[j] : start[j] + k] == mine).all():
                            hit[lo + i : lo + i + k] = True
                            items.add(self.names[item[j]])
        return hit, items


#: The index a worker process unpacked last, by the id of its broadcast.
_UNPACKED: dict[int, WindowIndex] = {}


def _unpacked(number: int, shared: Broadcast) -> WindowIndex:
    if number not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[number] = WindowIndex(shared.value)
    return _UNPACKED[number]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    keep: list[str] | None = None,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Add n_words, n_hit (words inside an occurrence of an item's window), items (sorted ids) to each row.

    Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII bytes.  Null texts have no
    words.  Benchmark rows without an id are searched like the rest and count as item "null"; items
    that share an id are one item; an item without words never occurs.  Repeated document rows each get their result; empty
    tables are fine.  Columns of ``docs`` named like a new one are replaced.
    """
    bench = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
    ).distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    if size > broadcast_words * 2:  # a word and its separator take two bytes at least
        return _by_shuffle(docs, bench, n, keep)
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(build_index([(r.item, bytes(r.body)) for r in bench.collect()], n))
    number = index._jbroadcast.id()
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>")]

    def start() -> Callable[[list], dict]:
        windows = _unpacked(number, index)

        def work(texts: list) -> dict:
            out: dict = {"n_words": [], "n_hit": [], "items": []}
            for t in texts:
                words = words_of(t)
                hit, items = windows.scan(words)
                out["n_words"].append(len(words))
                out["n_hit"].append(int(hit.sum()))
                out["items"].append(sorted(items))
            return out

        return work

    return map_texts(docs, start, fields, keep=keep)


def _word_array(text: Column) -> Column:
    """The words of a text as strings (JVM side).  Fixed pattern: what separates words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _by_shuffle(docs: DataFrame, bench: DataFrame, n: int, keep: list[str] | None) -> DataFrame:
    """The same rows by an equi-join of windows: for a benchmark too large to broadcast."""

    def windows(words: Column, k: Column, *more: Callable[[Column], Column]) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.slice(words, i + 1, k)).alias("w"), *[f(F.slice(words, i + 1, k)) for f in more]
        ))

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items")]
    word = F.col("words")
    b = bench.select("item", _word_array(F.col("body").cast("string")).alias("words")).where(F.size(word) > 0)
    b = b.withColumn("k", F.least(F.size(word), F.lit(n)))
    b = b.select("item", "k", F.explode(windows(word, F.col("k"), lambda x: x.alias("window"))).alias("x"))
    b = b.select("item", "k", "x.w", "x.window").distinct()
    d = docs.select(*row_key(), _word_array(F.coalesce(F.col("text"), F.lit(""))).alias("words")).distinct()
    lengths = [r.k for r in b.select("k").distinct().collect()]  # at most n
    # hashes of all windows meet; the few that meet are verified on the words of their document
    met = (
        d.withColumn("k", F.explode(F.lit(lengths).cast("array<int>")))
        .select("_k", "_h", "k", F.explode(windows(word, F.col("k"))).alias("x"))
        .select("_k", "_h", "k", "x.at", "x.w")
        .join(b, ["k", "w"])
    )
    hits = met.join(d, ["_k", "_h"]).where(F.slice(word, F.col("at") + 1, F.col("k")) == F.col("window"))
    found = hits.groupBy("_k", "_h").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))))).alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    n_words = F.size(_word_array(F.coalesce(F.col("text"), F.lit("")))).alias("n_words")
    base = docs.select(*row_key(), n_words, *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)])
    return base.join(found, ["_k", "_h"], "left").select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)],
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(found["n_hit"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(found["items"], F.array().cast("array<string>")).alias("items"),
    )


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
