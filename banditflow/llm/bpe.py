"""Byte-pair encoding as a bounded-lookahead streaming transducer, and an incremental decoder.

Bytes are pushed in pieces of any size.  The encoder keeps a buffer of bytes whose tokens are not
yet certain, merges it, and emits every token that ends at least ``lookahead`` bytes before the
buffer's end: no byte still to come can change those.  ``lookahead`` is computed from the merge
list, so the buffer has a fixed size whatever the length of the text.

Why the lookahead suffices.  Apply the merges in rank order to the bytes read so far, with anything
at all to follow.  Say all is certain up to a token boundary p.  Merge (u, v) can make the last
certain token uncertain only when that token is u and v may begin at p; then p moves left by |u|.
What then begins at p is u or a token made from u on the left, so the next merge (u', v') that moves p
must have a higher rank (the same pair repeats left to right, so its left side decides), and u must lie
on the left spine of v'.  The greatest total of |u| over such chains of merges bounds how far back
the future can reach.  A boundary of the final tokenisation is never crossed by a merge, so what
follows an emitted token is encoded on its own.

Pre-tokens (the tokenizer's split pattern) end a run: nothing merges across them.  Each short
pre-token is the same problem again and again, so results are remembered in a bounded memo.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banditflow.llm.texts import kept, map_texts

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A place where a pre-token surely begins: one space, or one line end, between two characters that
#: are no white space.  The space is dropped, the line end stays with what follows.
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


def _pieces(text: str) -> list[str]:
    """``text`` cut at ``_CUT``; plain splits do where no white space but single spaces and line ends occurs."""
    t = text.replace("\n", " \n")
    plain = "  " not in t and "\n " not in t and t[0] != " " and t[-1] not in " \n"
    if plain and text.replace("\n", "").isprintable():
        return t.split(" ")
    return _CUT.split(text)


def byte_alphabet() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the other
    bytes, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and special tokens of a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.specials.values()])
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.specials.items():
            self.bytes[i] = t.encode()
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges: list[tuple[int, int, int]] = []
        for a, b in pairs:
            a, b = raw(a), raw(b)
            self.merges.append((self.ids[a], self.ids[b], self.ids[a + b]))
        #: (left id, right id) -> rank; made[rank]: id of the merged token
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.merges)}
        self.made = [c for _, _, c in self.merges]
        self.slots, self.slot_ranks = _slots(np.array([a << 32 | b for a, b, _ in self.merges], np.int64))
        self.made_array = np.array(self.made, np.int64)
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(self.merges, [len(t) for t in self.bytes])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; that of a pair which does not merge is the number of merges."""
        key = left << 32 | right
        at = _slot(key, len(self.slots))
        there, out = self.slots[at], self.slot_ranks[at]
        other = there != key
        out[other] = len(self.made)
        again = np.nonzero(other & (there >= 0))
        key, at = key[again], at[again]
        while len(key):  # another pair holds that slot: this one may hold the next
            at = (at + 1) % len(self.slots)
            there = self.slots[at]
            hit = there == key
            out[tuple(x[hit] for x in again)] = self.slot_ranks[at[hit]]
            more = ~hit & (there >= 0)
            again, key, at = tuple(x[more] for x in again), key[more], at[more]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """First slot of a pair in a table of ``size`` (a power of 2) slots."""
    return (key * 0x2545F4914F6CDD1D >> 40) & (size - 1)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash table of the pairs, and the rank of the pair in each slot; -1: an empty slot."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, ranks = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    left, at = np.arange(len(keys)), _slot(keys, size)
    while len(left):
        empty = np.flatnonzero(slots[at] < 0)
        own = empty[np.unique(at[empty], return_index=True)[1]]
        slots[at[own]], ranks[at[own]] = keys[left[own]], left[own]
        left, at = np.delete(left, own), (np.delete(at, own) + 1) % size
    return slots, ranks


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: list[int]) -> int:
    """Greatest total length of a chain of left parts u1, u2, ... of merges of rising rank in which
    each u lies on the left spine of the next merge's right part."""
    spine: dict[int, list[int]] = {}  # token -> itself and its leftmost parts
    reach: dict[int, int] = {}  # token u -> greatest total of a chain that ends in u so far
    most = 0
    for a, b, c in merges:
        far = size[a] + max(reach.get(t, 0) for t in spine.get(b, (b,)))
        if far > reach.get(a, 0):
            reach[a] = far
            most = max(most, far)
        spine.setdefault(c, [c, *spine.get(a, [a])])
    return most


def merge_bytes(v: Vocabulary, data: bytes) -> list[int]:
    """Tokens of one whole run of bytes: merges by rank, the leftmost first."""
    ids = [v.of_byte[b] for b in data]
    if len(ids) > 64:
        return _merge_long(v, ids)
    rank, made, none = v.rank.get, v.made, len(v.made)
    found = [rank(p, none) for p in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best == none:
            break
        i = found.index(best)
        ids[i] = made[best]
        del ids[i + 1], found[i]
        if i < len(found):
            found[i] = rank((ids[i], ids[i + 1]), none)
        if i:
            found[i - 1] = rank((ids[i - 1], ids[i]), none)
    return ids


def _merge_long(v: Vocabulary, ids: list[int]) -> list[int]:
    """The same with a heap of pairs and links to neighbours, O(n log n)."""
    n = len(ids)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(v.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in v.rank]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = v.made[v.rank[a, b]], -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (p := (ids[x], ids[y])) in v.rank:
                heapq.heappush(heap, (v.rank[p], x, *p))
    return [t for t in ids if t >= 0]


def merge_many(v: Vocabulary, runs: list[bytes], chunk: int = 4096) -> list[bytes]:
    """Packed tokens of many short runs at once: every step does the next merge of each run (numpy).

    Runs of like length go together, ``chunk`` of them at a time.
    """
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(size, kind="stable")
    out: list[bytes] = [b""] * len(runs)
    for lo in range(0, len(order), chunk):
        own = order[lo : lo + chunk]
        for i, ids in zip(own.tolist(), _merge_chunk(v, [runs[i] for i in own.tolist()], size[own])):
            out[i] = ids
    return out


def _merge_chunk(v: Vocabulary, runs: list[bytes], size: np.ndarray) -> list[bytes]:
    """``merge_many`` of runs that are worked on together.

    Places run before runs; the last place holds nothing and takes what ended runs write.  A pair's rank and its
    place are one number, so the least one is the next merge.
    """
    width, bits = int(size.max()), int(size.max()).bit_length()
    none, place = len(v.made) << bits, np.arange(width + 1)[:, None]
    raw = np.frombuffer(b"".join(r.ljust(width + 1, b"\0") for r in runs), np.uint8).reshape(-1, width + 1)
    ids = np.array(v.of_byte, np.int64)[raw.T]
    found = np.full(ids.shape, none) + place
    found[:-1] = np.where(place[:-1] < size - 1, (v.ranks(ids[:-1], ids[1:]) << bits) + place[:-1], found[:-1])
    rows, own = np.arange(len(runs)), np.arange(len(runs))
    done, left_over = np.zeros((len(runs), width), "<u4"), size.copy()
    while len(rows):
        best = found.min(0)
        go = best < none
        if 8 * np.count_nonzero(go) <= 7 * len(rows):  # ended runs leave when there are many
            done[rows[~go]], left_over[rows[~go]] = ids[:width, ~go].T, size[~go]
            rows, ids, found, size, best, go = rows[go], ids[:, go], found[:, go], size[go], best[go], go[go]
            own = np.arange(len(rows))
        i = np.where(go, best & ((1 << bits) - 1), width)
        # drop place i + 1 of the ids and place i of the pairs, then rank the two new pairs
        np.copyto(ids[:-1], ids[1:], where=place[:-1] > i)
        np.copyto(found[:-1], found[1:] - 1, where=place[:-1] >= i)
        ids[i[go], own[go]] = v.made_array[best[go] >> bits]
        size = size - go
        for left in (i, i - 1):
            ok = go & (left >= 0) & (left < size - 1)
            r, c = own[ok], left[ok]
            found[c, r] = (v.ranks(ids[c, r], ids[c + 1, r]) << bits) + c
    packed = done[np.arange(width) < left_over[:, None]].tobytes()
    ends = (np.cumsum(left_over) * 4).tolist()
    return [packed[x:y] for x, y in zip([0, *ends], ends)]


class RunEncoder:
    """The transducer for one run of bytes without an inner boundary: push pieces, then finish."""

    def __init__(self, v: Vocabulary, block: int = 4096):
        self.v, self.block, self.buffer = v, block + 2 * v.lookahead, b""

    def push(self, data: bytes) -> list[int]:
        """Tokens that became certain."""
        out: list[int] = []
        for i in range(0, len(data), self.block):
            self.buffer += data[i : i + self.block]
            if len(self.buffer) > self.block:
                end, sure = len(self.buffer) - self.v.lookahead, 0
                for t in merge_bytes(self.v, self.buffer):
                    if sure + len(self.v.bytes[t]) > end:
                        break
                    sure += len(self.v.bytes[t])
                    out.append(t)
                self.buffer = self.buffer[sure:]
        return out

    def finish(self) -> list[int]:
        rest, self.buffer = self.buffer, b""
        return merge_bytes(self.v, rest)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Whole texts to little-endian uint32 ids.  As a dict it is the memo: stretch of text -> its ids.

    A text is cut at ``_CUT``; the split pattern always begins a pre-token there.
    """

    #: Stretches a generation of the memo may hold: two of them take some 60 MB, and stay with the worker.
    MEMO = 150_000

    def __init__(self, v: Vocabulary, memo: int = MEMO):
        import regex

        super().__init__()
        self.v, self.memo, self.old = v, memo, {}
        self.split = regex.compile(SPLIT)
        self.line_end = _packed(merge_bytes(v, b"\n"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.specials, key=len)[::-1])) + ")") if v.specials else None

    def pretoken(self, s: str) -> bytes:
        data = s.encode()
        if len(data) <= 64:  # shorter than any block: finished at once
            return _packed(merge_bytes(self.v, data))
        run = RunEncoder(self.v)
        return _packed(run.push(data) + run.finish())

    def __missing__(self, stretch: str) -> bytes:
        """``stretch``: what stood between two cuts; a space before it belongs to it, or it begins with a line end."""
        got = self.old.get(stretch)
        if got is None:
            got = self.line_end + self.stretch(stretch[1:]) if stretch[0] == "\n" else self.stretch(" " + stretch)
        if len(stretch) <= 64:
            self[stretch] = got
        return got

    def learn(self, stretches: set[str]) -> None:
        """Put the plain words among ``stretches`` that are not in the memo there, all in one go."""
        if len(self) >= self.memo:  # two generations: what was used lately survives one more round
            self.old = dict(self)
            self.clear()
        words = set()
        for s in stretches.difference(self):
            word = s[:-1] if s[-1:] in ".," else s
            if word not in self:
                if (known := self.old.get(word)) is not None:
                    self[word] = known
                elif (word[1:] if word[:1] == "\n" else word).isalpha():
                    words.add(word)
        runs = {w: w[1:].encode() if w[0] == "\n" else b" " + w.encode() for w in words}
        words = [w for w in words if len(runs[w]) <= 24]
        if words:
            for w, ids in zip(words, merge_many(self.v, [runs[w] for w in words])):
                self[w] = self.line_end + ids if w[0] == "\n" else ids

    def stretch(self, s: str) -> bytes:
        word = s[1:] if s[:1] == " " else s
        if word.isalpha():
            return self.pretoken(s)
        if word[:-1].isalpha() and word[-1] in ".,":  # a word that ends a clause: the commonest other case
            end = _packed([self.v.of_byte[ord(word[-1])]])
            if len(word) == len(s):
                return self["\n" + word[:-1]][len(self.line_end) :] + end
            return self[word[:-1]] + end
        parts = [m.group() for m in self.split.finditer(s)]
        if len(parts) == 1:
            return self.pretoken(s)
        return b"".join(self[p[1:]] if p[:1] == " " and p[1:].isalpha() else self.pretoken(p) for p in parts)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        return self.cut(_pieces(text)) if text else b""

    def cut(self, pieces: list[str]) -> bytes:
        return self.stretch(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))

    def __call__(self, text: str) -> bytes:
        if self.special is None or not any(s in text for s in self.v.specials):
            return self.plain(text)
        return b"".join(
            _packed([self.v.specials[p]]) if p in self.v.specials else self.plain(p) for p in self.special.split(text)
        )

    def many(self, texts: list[str], block: int = 1 << 21) -> Iterator[bytes]:
        """Ids of each text; the words of about ``block`` characters are learnt together."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= block):
                size += len(texts[j])
                j += 1
            cuts = [_pieces(t) if t else [] for t in texts[i:j]]
            self.learn(set().union(*cuts))
            for t, pieces in zip(texts[i:j], cuts):
                special = self.special is not None and any(s in t for s in self.v.specials)
                yield self(t) if special else self.cut(pieces) if t else b""
            i = j


def decode_ids(v: Vocabulary, ids: bytes, block: int = 1 << 16) -> str:
    """Ids back to text: an incremental UTF-8 state machine fed with the bytes of ``block`` tokens at a time.

    Bytes that are no UTF-8 become U+FFFD, one for each maximal broken part.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    at = np.frombuffer(ids, "<u4")
    of = v.bytes.__getitem__
    out = [machine.decode(b"".join(map(of, at[i : i + block].tolist()))) for i in range(0, len(at), block)]
    return "".join(out) + machine.decode(b"", True)


def loaded(path: str) -> tuple[Vocabulary, Encoder]:
    """One vocabulary and memo for each Python worker, as long as its tasks ask for them."""

    def load() -> tuple[Vocabulary, Encoder]:
        v = Vocabulary(path)
        return v, Encoder(v)

    return kept(("bpe", path), load)


def encode_texts(
    docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False
) -> DataFrame:
    """Add ``ids`` (binary, little-endian uint32) and, on request, ``decoded`` (the ids' text) to each row.

    ``vocabulary``: path of a byte-level BPE file in the tokenizers JSON form, readable where tasks
    run.  A null or empty text has no ids and decodes to "".  Special tokens that stand in a text
    become their ids.  Rows repeat as they do in ``docs``; an empty table gives an empty one.
    """
    fields = [("ids", "binary")] + [("decoded", "string")] * decoded

    def start() -> Callable[[list], dict]:
        v, encode = loaded(vocabulary)

        def work(texts: list) -> dict:
            ids = list(encode.many([t.decode("utf-8", "replace") for t in texts]))
            out: dict = {"ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array([decode_ids(v, x) for x in ids], pa.string())
            return out

        return work

    return map_texts(docs, start, fields, text, keep)


def token_digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encode_texts(..., decoded=True)``."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def iter_tokens(v: Vocabulary, chunks: Iterator[bytes]) -> Iterator[int]:
    """Tokens of a run of bytes that arrives in pieces (one pre-token), as each becomes certain."""
    run = RunEncoder(v)
    for c in chunks:
        yield from run.push(c)
    yield from run.finish()
