"""Repeated passages by prefix-free parsing: bytes covered by a string of ``length`` bytes seen earlier go.

Parsing.  A rolling hash names every 32-byte gram.  Every window of ``length`` bytes has its trigger:
the gram of least hash in it (leftmost among equals), which depends on the window's bytes alone.
A maximal run of window starts with one trigger is a phrase; its bytes reach from the first window's
start to the last one's end.  Equal windows have equal triggers at equal offsets, so all that can
match lies in phrases of one trigger.

Dictionary and parse.  Phrases that are equal around equal triggers are one dictionary entry, named
by (trigger, content).  Of the occurrences of an entry (the parse) the first in corpus order
(doc_id, start) stays open, all others are repeats as a whole: highly repetitive text is settled here,
one row a phrase.  An entry whose trigger no other entry has is unique.  Only the first occurrences
of entries that share a trigger with another entry (the edges of copied passages) are taken apart:
first into parts of up to eight suffixes, which take the place of phrases, the bytes that all eight
begin with or run through being their trigger; then what is still open into single suffixes, cut to
``length`` bytes.  Each time the names are put in corpus order in the same way.

Where textbook parsing sorts the suffixes of dictionary and parse to get the order of the corpus, this
takes names of equal prefixes of length 32 and ``length`` (built by doubling, as in the suffix-array
construction by naming) and sorts by (name, corpus position) in Spark's shuffle: only equality of
prefixes of one length is asked for, so the alphabetical order between names is not needed.

Before every shuffle a task settles what repeats inside its own batch and passes on one row for
each name, so a group of copies with a third of all rows loads no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from banditflow.llm.texts import U64, mix64, row_key
from banditflow.session import materialize

LENGTH, GRAM = 100, 32
_CHUNK = 1 << 18  # bytes hashed at once
_SHARE = 1 << 21  # bytes of texts taken out of a batch at once
_ROWS = 1 << 16  # rows settled at once, and those of one chunk more
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

#: One row a name: trigger g, content c, document (k, h), and place = lo << 16 | (anchor - lo) << 8 |
#: (hi - lo) << 1 for the window starts lo..hi.  A settled row (odd place) has hi in c: its windows repeat.
_ROW = "g long, c long, k long, h long, place long"
_NAMES = ["g", "c", "k", "h", "place"]
_PART = 8  # windows in a part of a phrase


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Names of concatenations."""
    x = a * U64(0xD1342543DE82EF95 + 2 * level)
    x ^= x >> U64(32)
    x += b
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    return x


def gram_names(t: np.ndarray) -> np.ndarray:
    """Name of the 32 bytes that begin at each position (by doubling: 1, 2, 4, ... bytes)."""
    h, size = _BYTE[t], 1
    for level in range(5):
        h = _join(h[:-size], h[size:], level)
        size *= 2
    return h


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in chunks of about _CHUNK bytes; a longer text comes in overlapping pieces."""
    chunk, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, _CHUNK):
            piece = t[at : at + _CHUNK + length - 1]
            if chunk and size + len(piece) > _CHUNK + length:
                yield chunk
                chunk, size = [], 0
            chunk.append((i, at, piece))
            size += len(piece)
    if chunk:
        yield chunk


def _starts(chunk: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a chunk joined; window starts in it; their text numbers and offsets in the texts."""
    size = np.array([len(p) for _, _, p in chunk])
    first = np.cumsum(size) - size
    n = size - length + 1
    x = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = np.repeat(np.arange(len(chunk)), n)
    text, offset = np.array([i for i, _, _ in chunk]), np.array([at for _, at, _ in chunk])
    return np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8), x, text[own], x - first[own] + offset[own]


def _phrases(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, lo, hi, trigger name, content name) of the phrases, in order."""
    grams = length - GRAM + 1
    for chunk in _pieces(texts, length):
        t, x, text, offset = _starts(chunk, length)
        h = gram_names(t)
        low = (h & U64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=U64)  # 40 bits of the name, then the place
        size = 1
        while 2 * size <= grams:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        trigger = (np.minimum(low[x], low[x + grams - size]) & U64(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(x), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (x[1:] != x[:-1] + 1)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(x)) - 1
        lo, hi, b = x[a], x[z], trigger[a]
        content = _join((b - lo).astype(U64), (hi - lo).astype(U64), 7)
        last = hi + length - GRAM
        for k in range(0, 2 * length, GRAM):
            content = _join(content, h[np.minimum(lo + k, last)], 8)
        yield text[a], offset[a], offset[z], offset[a] + (b - lo), h[b], content


def _open_rows(texts: list[bytes], open_: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Gram names of a chunk and, of the open rows in it, text number, shift (from text to chunk), lo, hi, anchor."""
    for chunk in _pieces(texts, length):
        base, found = 0, []
        for i, at, piece in chunk:
            rows = open_[i]
            if len(rows):
                rows = rows[(rows[:, 0] >= at) & (rows[:, 0] < at + _CHUNK)]  # phrases never cross pieces
                found.append(np.column_stack((np.full(len(rows), i), np.full(len(rows), base - at), rows)))
            base += len(piece)
        if found and len(rows := np.concatenate(found)):
            names = gram_names(np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8))
            yield names, *rows.T


def _parts(texts: list[bytes], open_: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Open phrases cut into parts of up to _PART windows, at multiples of _PART bytes from the trigger."""
    for h, text, shift, lo, hi, b in _open_rows(texts, open_, length):
        least = (b - hi) // _PART
        n = (b - lo) // _PART - least + 1
        row = np.repeat(np.arange(len(n)), n)
        q = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        text, shift, anchor = text[row], shift[row], b[row] - _PART * q
        lo, hi = np.maximum(lo[row], anchor - _PART + 1), np.minimum(hi[row], anchor)
        # every window of the part runs through the bytes from the anchor on, length - _PART + 1 of them
        g = np.zeros(len(lo), U64)
        for k in [*range(0, length - _PART + 1 - GRAM, GRAM), length - _PART + 1 - GRAM]:
            g = _join(g, h[anchor + shift + k], 9)
        content = _join((anchor - lo).astype(U64), (hi - lo).astype(U64), 7)
        for k in range(0, length, GRAM):
            content = _join(content, h[np.minimum(lo + k, hi + length - GRAM) + shift], 8)
        content = _join(content, h[hi + length - GRAM + shift], 8)
        yield text, lo, hi, anchor, g, content


def _windows(texts: list[bytes], open_: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The single windows of open parts, under two names."""
    for h, text, shift, lo, hi, _ in _open_rows(texts, open_, length):
        n = hi - lo + 1
        x = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, shift = np.repeat(text, n), np.repeat(shift, n)
        one = two = np.zeros(len(x), U64)
        for k in [*range(0, length - GRAM, GRAM), length - GRAM]:
            one, two = _join(one, h[x + shift + k], 9), _join(h[x + shift + k], two, 10)
        yield text, x, x, x, one, two


def _settle(parts: Iterator[tuple[np.ndarray, ...]], k: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_settled`` rows of about ``_ROWS`` parts at a time, so that what is held does not grow with the texts."""
    got, n = [], 0
    for part in parts:
        got.append(part)
        n += len(part[0])
        if n >= _ROWS:
            yield from _settled(got, k, h)
            n = 0
    if got:
        yield from _settled(got, k, h)


def _settled(got: list[tuple[np.ndarray, ...]], k: np.ndarray, h: np.ndarray) -> list[pa.RecordBatch]:
    """One open row for each name; what repeats an earlier row of ``got`` is settled, neighbours as one.  Empties ``got``."""
    out = []
    text, lo, hi, anchor, g, c = (np.concatenate(p) for p in zip(*got))
    got.clear()
    text = text.astype(np.int64)
    kk, hh = k[text], h[text]
    name = mix64(g ^ mix64(c.copy()))
    order = np.lexsort((lo, hh, kk, name))
    name, kk, hh, lo, hi, anchor, g, c = (v[order] for v in (name, kk, hh, lo, hi, anchor, g, c))
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    dup = (kk != kk[first]) | (hh != hh[first]) | (lo != lo[first])
    o = np.flatnonzero(dup)
    if len(o):
        o = o[np.lexsort((lo[o], hh[o], kk[o]))]
        edge = np.ones(len(o), bool)
        edge[1:] = (kk[o][1:] != kk[o][:-1]) | (hh[o][1:] != hh[o][:-1]) | (lo[o][1:] > hi[o][:-1] + 1)
        a = np.flatnonzero(edge)
        z = o[np.append(a[1:], len(o)) - 1]
        a = o[a]
        deal = mix64(kk[a].astype(np.uint64) ^ mix64(hh[a].astype(np.uint64))).view(np.int64)
        out.append(_batch(deal, hi[z], kk[a], hh[a], lo[a] << 16 | 1))
    i = np.flatnonzero(~dup)
    place = lo[i] << 16 | (anchor[i] - lo[i]) << 8 | (hi[i] - lo[i]) << 1
    out.append(_batch(g[i].view(np.int64), c[i].view(np.int64), kk[i], hh[i], place))
    return out


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=_NAMES)


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


def _texts(b: pa.RecordBatch, name: str = "body") -> list[bytes]:
    return b.column(name).to_pylist()


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about _SHARE bytes of texts, so that what is held beside them is bounded."""
    for b in batches:
        size = pc.binary_length(b.column("body")).to_numpy(zero_copy_only=False).astype(np.int64)
        share = np.cumsum(size) // _SHARE
        edge = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(share)]
        for lo, hi in zip(edge, edge[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _scan(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shares(batches):
            yield from _settle(_phrases(_texts(b), length), _column(b, "_k"), _column(b, "_h"))

    return run


def _take_apart(length: int, cut: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shares(batches):
            open_ = [
                np.array([[r["lo"], r["hi"], r["anchor"]] for r in rows], np.int64).reshape(-1, 3)
                for rows in b.column("open").to_pylist()
            ]
            yield from _settle(cut(_texts(b), open_, length), _column(b, "_k"), _column(b, "_h"))

    return run


def _in_order(rows: DataFrame, entries: bool) -> DataFrame:
    """Put the open rows in order by name, then corpus position; all but a name's first are settled.

    ``entries``: a name's first row stays open when its trigger ``g`` has another name, too.
    Streams sorted rows; only the open group's first rows are held.  (A settled row's g is a hash of
    its document, which only deals it out.)
    """
    dealt = rows.repartition("g").sortWithinPartitions(*_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # g, c and k, h, lo of the open name's first row
        several, waiting = False, None  # the open trigger has two names; else its only name's first row
        for b in batches:
            g, c, k, h, place = (_column(b, x) for x in _NAMES)
            done = (place & 1) == 1
            if done.any():
                yield _spans(True, k[done], h[done], place[done] >> 16, c[done], place[done] >> 16)
                g, c, k, h, place = (v[~done] for v in (g, c, k, h, place))
            n = len(g)
            if not n:
                continue
            lo, hi, anchor = place >> 16, (place >> 16) + (place >> 1 & 127), (place >> 16) + (place >> 8 & 255)
            new_g, new_c = np.ones(n, bool), np.ones(n, bool)
            new_g[1:] = g[1:] != g[:-1]
            new_c[1:] = new_g[1:] | (c[1:] != c[:-1])
            new_g[0] = last is None or g[0] != last[0]
            new_c[0] = new_g[0] or c[0] != last[1]
            first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            at = np.maximum(first, 0)
            k0, h0, lo0 = k[at], h[at], lo[at]
            if not new_c[0]:
                old = first < 0
                k0[old], h0[old], lo0[old] = last[2:]
            dup = np.flatnonzero((k != k0) | (h != h0) | (lo != lo0))
            if len(dup):
                yield _spans(True, *(v[dup] for v in (k, h, lo, hi, anchor)))
            if entries:
                group = np.cumsum(new_g) - new_g[0]  # 0: the group that was open (or the batch's first)
                names = np.bincount(group[new_c], minlength=group[-1] + 1)
                if not new_g[0]:
                    names[0] += 2 if several else 1
                many = names > 1
                if waiting is not None and not new_g[0] and many[0]:
                    yield _spans(False, *waiting)
                    waiting = None
                firsts = np.flatnonzero(new_c)
                send = firsts[many[group[firsts]]]
                if len(send):
                    yield _spans(False, *(v[send] for v in (k, h, lo, hi, anchor)))
                kept = firsts[(group[firsts] == group[-1]) & ~many[-1]]
                if len(kept):
                    waiting = tuple(v[kept[:1]] for v in (k, h, lo, hi, anchor))
                elif new_g.any() or many[-1]:
                    waiting = None
                several = bool(many[-1])
            last = (g[-1], c[-1], k0[-1], h0[-1], lo0[-1])

    return dealt.mapInArrow(run, "settled boolean, k long, h long, lo long, hi long, anchor long")


def _spans(settled: bool, *columns: np.ndarray) -> pa.RecordBatch:
    flags = pa.array(np.full(len(columns[0]), settled))
    return pa.RecordBatch.from_arrays(
        [flags, *(pa.array(v, pa.int64()) for v in columns)], names=["settled", "k", "h", "lo", "hi", "anchor"]
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, as_text: bool = False
) -> DataFrame:
    """Add rest (the bytes left; a string without cut characters if ``as_text``), n_bytes, n_removed, n_spans (maximal removed runs) to each row.

    A byte goes when a string of ``length`` (40 to 158) bytes that covers it also starts earlier: in a
    smaller doc_id, or earlier in the same document; overlaps count, and strings are judged on the
    input.  Matches never cross documents.  Null texts become empty; texts shorter than ``length`` stay
    whole.  A null doc_id is the smallest; rows that share a doc_id are ordered by a hash of their
    texts; exact repeats of a row are one document and get the same result.  Columns of ``docs`` named
    like a new one are replaced.
    """
    if not GRAM + _PART <= length < GRAM + 127:
        raise ValueError(f"length must be from {GRAM + _PART} to {GRAM + 126}")
    new = ["rest", "n_bytes", "n_removed", "n_spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    k, h = row_key()
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1").isEmpty():
        h = F.lit(0).cast("long").alias("_h")  # ids tell the rows apart; a constant costs nothing to move
    pass_ = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept) if c != "text"]
    # the same projection, all of it, goes into the three joins below, so that its exchange is made once
    body = docs.select(k, h, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"), *pass_)

    def apart(rows: DataFrame, cut: Callable) -> DataFrame:
        by_doc = rows.where(~F.col("settled")).groupBy(F.col("k").alias("_k"), F.col("h").alias("_h"))
        texts = body.join(by_doc.agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("open")), ["_k", "_h"])
        return texts.mapInArrow(_take_apart(length, cut), _ROW)

    rows = body.select("_k", "_h", "body").mapInArrow(_scan(length), _ROW)
    phrases = materialize(_in_order(rows, entries=True))
    parts = _in_order(apart(phrases, _parts), entries=True)
    windows = _in_order(apart(parts, _windows), entries=False)
    settled = phrases.where("settled").unionAll(parts.where("settled")).unionAll(windows.where("settled"))
    settled = settled.groupBy(F.col("k").alias("_k"), F.col("h").alias("_h")).agg(
        F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")
    )
    found = body.join(settled, ["_k", "_h"], "left")

    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in kept]
        + [T.StructField("rest", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in new[1:])]
    )
    text_null = docs.schema["text"].dataType if "text" in kept else None
    place = [f"__{i}" if c != "text" else "body" for i, c in enumerate(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shares(batches):
            out: dict = {c: [] for c in new}
            for t, los, his in zip(_texts(b), b.column("los").to_pylist(), b.column("his").to_pylist()):
                gone = np.zeros(len(t) + 1, np.int32)
                if los:
                    np.add.at(gone, los, 1)
                    np.add.at(gone, np.asarray(his) + length, -1)
                gone = np.cumsum(gone)[:-1] > 0
                stay = np.frombuffer(t, np.uint8)[~gone].tobytes() if los else t
                out["rest"].append(stay.decode("utf-8", "ignore") if as_text else stay)
                out["n_bytes"].append(len(t))
                out["n_removed"].append(len(t) - len(stay))
                out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if los else 0)
            columns = []
            for c in place:
                column = b.column(c)
                columns.append(column.cast(pa.string()) if c == "body" and isinstance(text_null, T.StringType) else column)
            columns += [pa.array(out["rest"], pa.string() if as_text else pa.binary()), *(pa.array(out[c], pa.int64()) for c in new[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return found.select("body", "los", "his", *[c for c in place if c != "body"]).mapInArrow(run, schema)


def repeat_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("rest"), 256).alias("kept_sha256"))
