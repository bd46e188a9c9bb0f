"""Language-model scoring with a causal self-attention model over subword ids, trained in numpy.

Words (A-Z lower-cased, split at ASCII white space) are encoded by a byte-level BPE.  The model reads
the subwords before a place through one layer of causal self-attention (attention by content and
distance, values, a residual path) and predicts the class of the next subword; within a class, subwords follow their
counts in the whole training corpus.  Classes keep subwords that begin a word (and the end) apart
from those that go on with one, so the model gives each whole word a probability; this is mixed with the
word's share in the training corpus.  The mixture is a proper distribution over words.

Everything is learnt from all training texts, whole; what comes to the driver is bounded by the vocabulary
or the number of parameters.
* Word counts, and subword counts derived from them.
* Classes: k-means on company counts (vocabulary x COMPANY cells, summed over the corpus).
* Attention weights: texts are cut into pieces of PIECE places, which a hash deals to groups of about GROUP
  places, as many as the corpus needs, and to ROUNDS rounds.  In a round each group goes by Adam over its pieces
  of the round, all from the same weights, and the mean of the groups' weights, by blocks, starts the next
  round.  Each block is used once; small corpora go over their blocks again until STEPS steps are made.
* The mixture's share: EM over the words of the one text in KEPT that is kept out of classes and weights.  The EM
  needs only how often each difference of the two log probabilities occurs, counted in steps of 1 / FINE.

Scoring cuts a text's subwords into blocks of BLOCK; each block attends, masked, to itself and
the block before, so windows overlap and every token is scored once with BLOCK to 2 * BLOCK - 1
subwords of context.  Counts of the commonest words (at most ``head``) are broadcast; all other words meet
their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.llm.bpe import Encoder, loaded
from banditflow.llm.texts import LOWER, U64, mix64, row_key, slices, tidied
from banditflow.session import materialize, release

BLOCK, STARTS, INNERS, WIDTH = 16, 24, 24, 16
HEAD, COMPANY = 1 << 18, 64
PIECE, GROUP, ROUNDS, STEPS, BATCH, RATE = 64 * BLOCK, 1 << 20, 8, 300, 96, 0.02
KEPT, FINE = 16, 64

END = "\n"  # the end token among the words: no word holds a line end


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _strings(text: bytes) -> list[str]:
    """The words of a text as strings (decoded in one go; no word holds a line end); ``_parsed`` finds the same."""
    words = words_of(text)
    return b"\n".join(words).decode("utf-8", "replace").split("\n") if words else []


@dataclass
class _Parsed:
    """Words and subwords of several texts, joined; each text's end is a word and a subword."""

    words: list[str]  # the distinct words, END last
    word: np.ndarray  # number of each word of the texts
    n_words: np.ndarray  # of each text
    ids: np.ndarray  # the subwords of the texts
    lens: np.ndarray  # number of each word's subwords

    @property
    def first(self) -> np.ndarray:  # of each text, among the words
        return np.cumsum(self.n_words) - self.n_words

    @property
    def sizes(self) -> np.ndarray:  # subwords of each text
        return np.add.reduceat(self.lens, self.first)


def _parsed(encode: Encoder, texts: list[bytes], end: int) -> _Parsed:
    """The texts' words and subwords; each distinct word is encoded once, ``end`` is the id of the end."""
    low = pa.array([t.translate(LOWER).decode("utf-8", "replace") for t in texts], pa.string())
    split = pc.ascii_split_whitespace(low)
    flat, edges = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
    real = pc.binary_length(flat).to_numpy() > 0  # white space at the edges of a text gives empty ones
    found = (flat if real.all() else flat.filter(pa.array(real))).dictionary_encode()
    words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    at = np.concatenate(([0], np.cumsum(real)))[edges]  # each text's first word
    word = np.insert(found.indices.to_numpy().astype(np.int64), at[1:], len(words))
    codes, size = _encoded(encode, words)
    codes, size = np.append(codes, end), np.append(size, 1)
    lens = size[word]
    begin = (np.cumsum(size) - size)[word] - (np.cumsum(lens) - lens)
    return _Parsed([*words, END], word, np.diff(at) + 1, codes[np.repeat(begin, lens) + np.arange(lens.sum())], lens)


class _Counts(dict):
    """word -> count, 0 for any other word."""

    def __missing__(self, word: str) -> int:
        return 0


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, n) over the training rows of ``docs``; every text ends in one END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("utf-8", "replace") for w in part]), pa.array([seen[w] for w in part], pa.int64())],
                    names=["word", "n"],
                )
            seen.clear()

        for b in batches:
            for t in b.column("body").to_pylist():
                seen.update(words_of(t))
                seen[END.encode()] += 1
                if len(seen) > limit:  # memory stays bounded; the sums come together in the shuffle
                    yield from out()
        yield from out()

    body = docs.where(~held_out()).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    return body.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_subwords(words: DataFrame, vocabulary: str, size: int) -> np.ndarray:
    """How often each subword occurs in the training texts, from the word counts; the last one is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = loaded(vocabulary)
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                part = b.slice(lo, 20_000)
                ids, lens = _encoded(encode, part.column("word").to_pylist())
                np.add.at(total, ids, np.repeat(part.column("n").to_numpy(), lens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    found = words.where(F.col("word") != END).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.float64)
    for r in found.collect():  # at most one row for each id of the vocabulary
        total[r.id] = r.n
    return total


def _encoded(encode: Encoder, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words (each as after a space), joined, and the number of each word's ids."""
    encode.learn(set(words))
    parts = list(map(encode.__getitem__, words))
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64), lens


@dataclass
class Model:
    """Classes of the subwords and the attention model over them."""

    cls: np.ndarray  # class of each subword; the end is the last subword
    inside: np.ndarray  # log probability of each subword in its class
    query: np.ndarray
    key: np.ndarray
    near: np.ndarray  # attention by distance 0 .. 2 * BLOCK - 1
    value: np.ndarray
    rest: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    mix: float  # share of the word counts in a word's probability

    @property
    def blank(self) -> int:  # what a context holds before the text; the text's start is blank + 1
        return len(self.bias)


_REACH = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)  # distance of key from query; < 0: not yet there
_SEEN, _DISTANCE = _REACH >= 0, np.maximum(_REACH, 0)
_UNIT = np.eye(STARTS + INNERS + 2, dtype=np.float32)


def _tables(m: Model) -> tuple[np.ndarray, ...]:
    """The attention's factors, exponentiated while they are small tables, in single precision: by content, by
    distance, values with a column of ones (which sums the weights), rest, out, bias; and the rows of classes as unit vectors."""
    weight = np.exp((m.query @ m.key.T).astype(np.float32))
    weight[:, m.blank] = 0.0
    weight[m.blank, m.blank] = 1e-9
    near = np.where(_SEEN, np.exp(m.near)[_DISTANCE], 0).astype(np.float32)
    value = np.concatenate((m.value, np.ones((len(m.value), 1))), 1)
    return weight, near, *(x.astype(np.float32) for x in (value, m.rest, m.out, m.bias)), _UNIT


def _attend(tables: tuple[np.ndarray, ...], q: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class scores after each query place, factors by content, weights by class of key, their sums, hidden states.

    Keys of one class differ in their distance alone, so ``near`` has the distances' factors summed by class.
    q: (n) classes, near: (n, classes).
    """
    weight, _, value, rest, out, bias, _ = tables
    w = weight.take(q, 0)
    p = w * near
    h = p @ value
    total = h[:, WIDTH:] + np.float32(1e-12)
    h = h[:, :WIDTH] / total
    h += rest.take(q, 0)
    z = h @ out
    z += bias
    return z, w, p, total, h


def _place_scores(m: Model, ids: np.ndarray, sizes: np.ndarray, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For the subwords of texts of ``sizes`` places, joined: their log probabilities, and the log probability, at
    each of them, that any subword that begins a word (or the end) comes.

    Texts are laid out in blocks.  Before a text stand one blank block and the start; the class after a place is the one to predict.
    """
    n, cls = m.blank, m.cls[ids]
    span = -(-sizes // BLOCK) * BLOCK + BLOCK
    own = np.arange(len(ids)) + np.repeat(np.cumsum(span) - span + BLOCK - (np.cumsum(sizes) - sizes), sizes)  # where each is predicted
    row = np.full(int(span.sum()), n)
    row[own[:-1] + 1] = cls[:-1]  # the last ones of texts are not read: what they wrote is mended below
    last = np.cumsum(sizes) - 1
    row[(own[last] + 1)[own[last] + 1 < len(row)]] = n
    row[own[last - sizes + 1]] = n + 1
    follow = np.zeros(len(row), np.int64)
    follow[own] = cls
    blocks, follow = row.reshape(-1, BLOCK).T, follow.reshape(-1, BLOCK).T
    p, s = np.zeros(blocks.shape, np.float32), np.zeros(blocks.shape, np.float32)
    tables = _tables(m)
    near, unit = tables[1], tables[6]
    kinds = np.stack((np.arange(n) < STARTS, np.ones(n)), 1).astype(np.float32)
    for i in range(1, blocks.shape[1], chunk):
        q = np.ascontiguousarray(blocks[:, i : i + chunk])
        c = q.shape[1]
        seen = unit.take(blocks[:, i - 1 : i + c], 0).reshape(BLOCK, -1)
        by_class = near[:, :BLOCK] @ seen[:, : c * (n + 2)]
        by_class += near[:, BLOCK:] @ seen[:, n + 2 :]
        z = _attend(tables, q.ravel(), by_class.reshape(-1, n + 2))[0]
        z -= z.max()  # scores lie close enough together for one shift
        chosen = z[np.arange(len(z)), follow[:, i : i + c].ravel()]
        np.exp(z, out=z)
        begin, whole = (z @ kinds).T
        p[:, i : i + c] = (chosen - np.log(whole)).reshape(BLOCK, c)
        s[:, i : i + c] = np.log(begin / whole).reshape(BLOCK, c)
    return p.T.ravel()[own].astype(float) + m.inside[ids], s.T.ravel()[own].astype(float)


def predict(m: Model, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two log probabilities of ``_place_scores`` for each text's subwords (the end last)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(sizes)[:-1]
    p, s = _place_scores(m, np.concatenate(texts), sizes)
    return list(zip(np.split(p, at), np.split(s, at)))


def word_scores(m: Model, ids: np.ndarray, lens: np.ndarray, got: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log probability of each word, the end included: that it begins so, goes on so, and then stops."""
    p, s = got
    first = np.concatenate(([0], np.cumsum(lens)))  # the end's place comes last
    out = np.add.reduceat(p, first) - s[first]
    out[:-1] += s[first[1:]]
    return out


def _word_scores(m: Model, part: pa.RecordBatch) -> np.ndarray:
    """``word_scores`` of the words of several texts (rows of ``read_texts``)."""
    pieces, kind = part.column("pieces"), _kind(len(m.cls))
    skip = (BLOCK + 1) * kind.itemsize  # what a piece has before its own places
    own = [x[skip:] for x in pieces.flatten().field("ids").to_pylist()]
    ids = np.frombuffer(b"".join(own), kind).astype(np.int64)
    sizes = np.add.reduceat(np.fromiter(map(len, own), np.int64, len(own)) // kind.itemsize, _edges(pieces)[:-1])
    p, s = _place_scores(m, ids, sizes)
    first = np.flatnonzero(m.cls[ids] < STARTS)
    out = np.add.reduceat(p, first) - s[first]
    inner = np.flatnonzero(ids[first] < len(m.cls) - 1)
    out[inner] += s[first[inner + 1]]
    return out


def _kind(size: int) -> np.dtype:
    """Of stored numbers, for ``size`` subwords and what stands for none or a start, or for so many levels."""
    return np.dtype("<u2" if size + 2 <= 1 << 16 else "<u4")


def _edges(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among the values of all, and where the last one ends."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def _levels(part: pa.RecordBatch, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level of each word of the texts, and the texts' numbers of words."""
    kind, level = _kind(len(top)), part.column("level")
    n = pc.binary_length(level).to_numpy().astype(np.int64) // kind.itemsize
    return np.frombuffer(b"".join(level.to_pylist()), kind).astype(np.int64), n


def _columns(counts: np.ndarray) -> np.ndarray:
    """Number of each subword among the COMPANY commonest, -1 for the others; one place more for gaps between texts."""
    out = np.full(len(counts) + 1, -1)
    common = np.argsort(-counts, kind="stable")[:COMPANY]
    out[common] = np.arange(len(common))
    return out


def _company(
    texts: list[np.ndarray], column: np.ndarray, window: int = 1 << 17, total: np.ndarray | None = None
) -> np.ndarray:
    """How often each subword of the texts stands 1, 2, 3, 5 or 8 places from each of the commonest ones (cells, flat).

    Counts are added to ``total``, when given, in place; beside it only the pairs of one window and distance are held.
    """
    size = len(column) - 1
    gap = np.full(8, size)
    flat = np.concatenate([x for t in texts for x in (t, gap)])
    if total is None:
        total = np.zeros(size * COMPANY, np.int64)
    for lo in range(0, len(flat), window):
        own = flat[lo : lo + window + 8]
        of, n = column[own], min(window, len(own))
        for d in (1, 2, 3, 5, 8):
            e = min(n, len(own) - d)  # the pairs that begin in this window
            for i, j in ((0, d), (d, 0)):
                at = np.flatnonzero((of[j : j + e] >= 0) & (own[i : i + e] < size))
                np.add.at(total, own[i : i + e][at] * COMPANY + of[j : j + e][at], 1)
    return total


def _classes(company: np.ndarray, counts: np.ndarray, begins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Classes of subwords by k-means on the company they keep; 0..STARTS-1 begin words.

    Subwords without company share the last class of their kind; the end has class 0 to itself.
    """
    size = len(begins)
    company = company.reshape(size, COMPANY).astype(float)
    seen = np.where(company.any(1), np.maximum(counts, 1), 0)
    company = np.sqrt(company / np.maximum(company.sum(1, keepdims=True), 1))
    cls = np.where(begins, STARTS - 1, STARTS + INNERS - 1)
    cls[-1] = 0
    for kind, lo, n in ((True, 1, STARTS - 2), (False, STARTS, INNERS - 1)):
        own = np.flatnonzero((begins == kind) & (seen > 0))
        own = own[own != size - 1]
        if not len(own):
            continue
        x, weight = company[own], seen[own].astype(float)
        centre = x[rng.choice(len(own), min(n, len(own)), replace=False, p=weight / weight.sum())]
        for _ in range(12):
            near = ((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)).argmin(1)
            total = np.bincount(near, weight, len(centre))
            moved = np.stack([np.bincount(near, weight * x[:, j], len(centre)) for j in range(COMPANY)], 1)
            centre = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-9)[:, None], centre)
        cls[own] = lo + near
    return cls


def start(company: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> Model:
    """Classes from the company counts, their contents from the corpus counts, attention weights before any training."""
    rng = np.random.default_rng(7)
    n = STARTS + INNERS
    cls = _classes(company, counts, begins, rng)
    within = np.bincount(cls, counts + 1, n)
    inside = np.log((counts + 1) / within[cls])
    share = np.log(np.maximum(np.bincount(cls, counts, n), 1) / max(counts.sum(), 1))
    small = lambda *shape: rng.normal(0, 0.1, shape)
    return Model(
        cls, inside, small(n + 2, 8), small(n + 2, 8), -0.05 * np.arange(2 * BLOCK, dtype=float),
        small(n + 2, WIDTH), small(n + 2, WIDTH), small(WIDTH, n), share, 0.5,
    )


_NAMES = ("query", "key", "near", "value", "rest", "out", "bias")


def _weights(m: Model) -> np.ndarray:
    return np.concatenate([getattr(m, x).ravel() for x in _NAMES])


def _with_weights(m: Model, flat: np.ndarray) -> Model:
    cut = np.split(flat, np.cumsum([getattr(m, x).size for x in _NAMES])[:-1])
    return replace(m, **{x: c.reshape(getattr(m, x).shape) for x, c in zip(_NAMES, cut)})


def pieces_of(text: np.ndarray, size: int) -> list[np.ndarray]:
    """A text's subwords (the end last) cut for training: PIECE places, the block before them, and what follows the last.

    ``size`` stands for no subword, ``size + 1`` for the text's start.
    """
    row = np.concatenate((np.full(BLOCK, size), [size + 1], text))
    return [row[lo : lo + PIECE + BLOCK + 1] for lo in range(0, len(text), PIECE)]


def descend(
    m: Model, pieces: list[np.ndarray], least: int, batch: int = BATCH, rate: float = RATE, seed: int = 7, done: float = 0.0,
    share: float = 1.0,
) -> tuple[Model, int]:
    """The model after Adam steps over all blocks of the pieces, in random order, and the number of blocks.

    ``least`` steps at least (then over the blocks again); these steps are ``share`` of all, ``done`` lies behind.
    """
    rng = np.random.default_rng(seed)
    n = m.blank
    cls = np.append(m.cls, (n, n + 1))
    blocks, follow = [], []
    for piece in pieces:
        c = cls[piece]
        places = len(c) - BLOCK - 1
        pad = np.full(-places % BLOCK, n)
        blocks.append(np.concatenate((c[:-1], pad)))
        follow.append(np.concatenate((np.full(BLOCK, n), c[BLOCK + 1 :], pad)))
    rows = np.concatenate([np.arange(BLOCK, len(b), BLOCK) // BLOCK + at for b, at in zip(blocks, _starts(blocks))])
    blocks, follow = np.concatenate(blocks).reshape(-1, BLOCK), np.concatenate(follow).reshape(-1, BLOCK)
    order = rng.permutation(rows)
    steps = max(-(-len(rows) // batch), least)
    flat = _weights(m)
    m = _with_weights(m, flat)  # parts of ``flat``, which each step changes in place
    first_m, second = np.zeros_like(flat), np.zeros_like(flat)
    ones = np.ones(n, np.float32)
    at = 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(rows), 0
        i = order[at : at + batch]
        at += batch
        k = np.concatenate((blocks[i - 1].T, blocks[i].T))  # places run before blocks, so one product sums over distances
        q, y = k[BLOCK:].ravel(), follow[i].T.ravel()
        tables = _tables(m)
        near, value, out, unit = tables[1], tables[2], tables[4], tables[6]
        keys = unit.take(k, 0).reshape(2 * BLOCK, -1)
        queries = keys[BLOCK:].reshape(-1, n + 2)
        z, w, p, total, h = _attend(tables, q, (near @ keys).reshape(-1, n + 2))
        top = z.max()
        z -= top if z.min() > top - 60 else z.max(1, keepdims=True)  # mostly one shift does
        dz = np.exp(z, out=z)
        dz /= (dz @ ones)[:, None]
        real = np.flatnonzero(y < n)
        dz[real, y[real]] -= 1
        dz *= ((y < n) / np.float32(max(len(real), 1))).astype(np.float32)[:, None]
        dh = dz @ out.T
        dv = np.empty((len(q), WIDTH + 1), np.float32)
        np.divide(dh, total, out=dv[:, :WIDTH])
        np.einsum("ij,ij->i", dv[:, :WIDTH], tables[3].take(q, 0) - h, out=dv[:, WIDTH])
        dp = dv @ value.T
        by_distance = (dp * w).reshape(BLOCK, -1) @ keys.T
        by_distance *= near
        dp *= p
        table = queries.T @ dp
        g = {
            "query": table @ m.key,
            "key": table.T @ m.query,
            "near": np.bincount(_DISTANCE.ravel(), by_distance.ravel(), 2 * BLOCK),
            "value": p.T @ dv[:, :WIDTH],
            "rest": queries.T @ dh,
            "out": h.T @ dz,
            "bias": np.ones(len(dz), np.float32) @ dz,
        }
        g = np.concatenate([g[x].ravel() for x in _NAMES])
        first_m = 0.9 * first_m + 0.1 * g
        second = 0.99 * second + 0.01 * g**2
        pace = rate * min(1.0, 2 * (1 - done - share * step / (steps + 1)))
        flat -= pace * (first_m / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return m, len(rows)


def _starts(blocks: list[np.ndarray]) -> np.ndarray:
    """Number of the first block of each piece."""
    return np.cumsum([0, *(len(b) // BLOCK for b in blocks[:-1])])


def fit(
    texts: list[np.ndarray], begins: np.ndarray, counts: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE
) -> Model:
    """The model of texts that are in memory (subword ids, the end last): one group, one round, ``steps`` steps or more."""
    column = _columns(np.bincount(np.concatenate(texts), minlength=len(begins)) if texts else counts)
    company = _company(texts, column) if texts else np.zeros(len(begins) * COMPANY, np.int64)
    m = start(company, begins, counts)
    return descend(m, [p for t in texts for p in pieces_of(t, len(begins))], steps, batch, rate)[0] if texts else m


def kept_out(text: str = "text") -> Column:
    """Training rows that classes and weights never see; the mixture's share is fitted on them (copies of a text stay together)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))), F.lit(KEPT)) == 0


def read_texts(
    docs: DataFrame, vocabulary: str, column: np.ndarray, known: dict, levels: int, learn: Column, keep: Column
) -> DataFrame:
    """Every text of ``docs``, taken apart once for training and scoring, and the company counts of those with ``learn``.

    Rows of texts: _k, _h, doc_id, learn, keep, pieces (deal, ids: see ``pieces_of``), level (``known``'s number, below
    ``levels``, of each word, the end included; 0: rare) and rare (the words of level 0, in order).  Other rows: cell, n.
    """
    size = len(column) - 1
    kind, level_kind = _kind(size), _kind(levels)
    names = ["_k", "_h", "doc_id", "learn", "keep", "pieces", "level", "rare", "cell", "n"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = loaded(vocabulary)
        level_of = shared.value
        total = np.zeros(size * COMPANY, np.int64)
        columns = []
        for b in batches:
            for part in slices(b):
                x = _parsed(encode, part.column("body").to_pylist(), size - 1)
                texts = np.split(x.ids, np.cumsum(x.sizes)[:-1])
                keys = mix64(part.column("_k").to_numpy().view(U64) * U64(3) + part.column("_h").to_numpy().view(U64))
                deal, ids, edges = [], [], [0]
                for key, t in zip(keys, texts):
                    own = pieces_of(t, size)
                    deal.append(mix64(key + np.arange(len(own), dtype=U64) * U64(0x9E3779B97F4A7C15)))
                    ids += [y.astype(kind).tobytes() for y in own]
                    edges.append(len(ids))
                pieces = pa.StructArray.from_arrays([pa.array(np.concatenate(deal).view(np.int64)), pa.array(ids, pa.binary())], ["deal", "ids"])
                level = np.fromiter(map(level_of.__getitem__, x.words), level_kind, len(x.words))[x.word]
                rare = np.flatnonzero(level == 0)
                at = np.append(x.first, len(level))
                words = pa.array(x.words, pa.string()).take(pa.array(x.word[rare]))
                columns = [part.column(c) for c in names[:5]] + [
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pieces),
                    pa.array([level[lo:hi].tobytes() for lo, hi in zip(at, at[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at), pa.int32()), words),
                ]
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, none, none], names=names)
                own = part.column("learn").to_numpy(zero_copy_only=False)
                if own.any():
                    _company([t for t, y in zip(texts, own) if y], column, total=total)
        for lo in range(0, len(total), 100_000):
            at = lo + np.flatnonzero(total[lo : lo + 100_000])
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), c.type) for c in columns), pa.array(at), pa.array(total[at])], names=names)

    body = docs.select(
        *row_key(), "doc_id", learn.alias("learn"), keep.alias("keep"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")
    )
    return body.mapInArrow(
        tidied(run),
        f"_k long, _h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, learn boolean, keep boolean, "
        "pieces array<struct<deal: long, ids: binary>>, level binary, rare array<string>, cell long, n long",
    )


def _pieces(read: DataFrame) -> DataFrame:
    """The pieces (deal, ids) of the texts to learn from."""
    return read.where("learn").select(F.explode("pieces").alias("x")).select("x.deal", "x.ids")


def _dealt(docs: DataFrame, vocabulary: str, column: np.ndarray) -> DataFrame:
    """All texts of ``docs`` as rows (deal, ids), one a piece, and rows (cell, n) of their company counts."""
    read = read_texts(docs, vocabulary, column, _Counts(), 1, F.lit(True), F.lit(False))
    none = F.lit(None).cast("long")
    cells = read.where("cell is not null").select(none.alias("deal"), F.lit(None).cast("binary").alias("ids"), "cell", "n")
    return _pieces(read).withColumns({"cell": none, "n": none}).unionAll(cells)


def _trained(m: Model, pieces: DataFrame, places: int) -> Model:
    """The model trained on all pieces, round by round: each group from the same weights, then their mean by blocks."""
    size = len(m.cls)
    kind = _kind(size)
    groups = max(1, -(-places // GROUP))
    parts = min(groups, max(48, groups // 4))  # a task takes its groups one after the other
    rounds = ROUNDS if groups > 1 else 1
    deal = pieces.select(
        F.pmod("deal", F.lit(groups)).alias("g"), F.pmod(F.shiftright("deal", 40), F.lit(rounds)).alias("r"), "deal", "ids"
    )
    for r in range(rounds):
        shared = pieces.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(_weights(shared.value)) + 1)
            group, own = None, []

            def learn() -> None:
                got, blocks = descend(shared.value, own, -(-STEPS // rounds), seed=r, done=r / rounds, share=1 / rounds)
                total[:-1] += blocks * _weights(got)
                total[-1] += blocks

            for b in batches:
                for g, ids in zip(b.column("g").to_pylist(), b.column("ids").to_pylist()):
                    if g != group and own:
                        learn()
                        own = []
                    group = g
                    own.append(np.frombuffer(ids, kind))
            if own:
                learn()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        part = deal.where(F.col("r") == r).repartition(parts, "g").sortWithinPartitions("g", "deal").select("g", "ids")
        sums = part.mapInArrow(tidied(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if sums:  # a row for each parameter, the number of blocks last
            flat = np.array([x for _, x in sorted(map(tuple, sums))])
            m = _with_weights(m, flat[:-1] / flat[-1])
    return m


def fit_mix(apart: np.ndarray, times: np.ndarray, rounds: int = 20) -> float:
    """Share of the word counts in the mixture, by EM; ``apart``: log probability by counts less that by attention."""
    share = 0.5
    for _ in range(rounds if len(apart) else 0):
        a = np.log(share) + apart
        share = float(np.clip(np.average(np.exp(a - np.logaddexp(a, np.log1p(-share))), weights=times), 0.02, 0.98))
    return share


def _mix(read: DataFrame, words: DataFrame, m: Model, top: np.ndarray, base: int) -> float:
    """The mixture's share from all words of the texts ``read``, whose own occurrence is taken off their counts."""
    shared = read.sparkSession.sparkContext.broadcast((m, top))
    names = ["word", "p", "cell", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = shared.value
        total: Counter = Counter()
        with np.errstate(divide="ignore"):
            counted = np.log(count / base)
        for b in batches:
            for part in slices(b):
                p, (level, _) = _word_scores(own, part), _levels(part, count)
                common = level > 0
                cells = np.floor((counted[level[common]] - p[common]) * FINE).astype(int)
                total.update(dict(zip(*(y.tolist() for y in np.unique(cells, return_counts=True)))))
                rare = part.column("rare").flatten()
                none = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays([rare, pa.array(p[~common]), none, none], names=names)
        none = pa.nulls(len(total))
        cells = [pa.array(list(x), pa.int64()) for x in (total.keys(), total.values())]
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.float64()), *cells], names=names)

    found = materialize(read.select("pieces", "level", "rare").mapInArrow(tidied(run), "word string, p double, cell long, n long"))
    apart = F.floor((F.log(F.col("c") / base) - F.col("p")) * FINE)
    joined = found.where("word is not null").drop("n", "cell").join(words.withColumnRenamed("n", "c"), "word")
    rare = joined.select(apart.alias("cell"), F.lit(1).cast("long").alias("n"))
    cells = found.where("word is null").select("cell", "n").unionAll(rare).groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sorted(map(tuple, cells.collect()))  # a few thousand differences
    release(found)
    apart, times = np.array(rows, float).reshape(-1, 2).T
    return fit_mix((apart + 0.5) / FINE, times)


def _inputs(code: Encoder, given: list[list[str]], end: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its subword ids, the end last, and the number of each word's ids."""
    ids, lens = _encoded(code, [w for ws in given for w in ws])
    word_at = np.concatenate(([0], np.cumsum([len(ws) for ws in given], dtype=np.int64)))
    id_at = np.concatenate(([0], np.cumsum(lens)))[word_at]
    return (
        [np.append(ids[a:z], end) for a, z in zip(id_at, id_at[1:])],
        [lens[a:z] for a, z in zip(word_at, word_at[1:])],
    )


def score_texts(docs: DataFrame, vocabulary: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row.

    Tokens: the words and one end.  base_score: sum of log10((c + 1) / (N + V + 1)), c the token's count in
    the training rows, N all, V distinct ones.  score: log10 probability of the text under the model.  A
    null or blank text has the end alone.  A null doc_id counts as "" in the split.  Rows that repeat are
    trained on and scored as often as they come; without training rows all counts are 0.
    """
    spark = docs.sparkSession
    v, _ = loaded(vocabulary)
    size = len(v.bytes) + 1
    begins = np.array([t[:1] == b" " for t in v.bytes] + [True])
    words = materialize(count_words(docs))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, base = int(total[0]), int(total[0]) + int(total[1]) + 1
    # the least count that leaves at most ``head`` words, from a histogram of at most 64 * 8 counts
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()
    kept, least = 0, None
    for r in sorted(steps, key=lambda r: -r.s):
        if kept + r.k > head:
            break
        kept, least = kept + r.k, r.s
    common = words.where(F.floor(F.log2("n") * 8) >= F.lit(least)) if least is not None else words.limit(0)
    table = common.toArrow()
    counts = _Counts(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))  # as the tasks read it: no copy there

    # a word's level is the number of its count among the counts that occur, 0 for the words that go to the join
    top = np.unique([0, *counts.values()])
    known = _Counts(zip(counts, np.searchsorted(top, list(counts.values())).tolist()))

    of_subword = count_subwords(words, vocabulary, size)
    of_subword[-1] = counts.get(END, 0)
    column = _columns(of_subword)
    learn, keep = ~held_out() & ~kept_out(), ~held_out() & kept_out()
    if docs.where(learn).isEmpty() or docs.where(keep).isEmpty():  # too few texts to keep any out
        learn = keep = ~held_out()
    read = materialize(read_texts(docs, vocabulary, column, known, len(top), learn, keep))
    cells = read.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    company = np.zeros(size * COMPANY, np.int64)  # at most so many rows
    company[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    del cells
    model = start(company, begins, of_subword)
    model = _trained(model, _pieces(read), int(of_subword.sum()))
    model.mix = _mix(read.where("keep"), words, model, top, base)
    shared = spark.sparkContext.broadcast((model, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, count = shared.value
        for b in batches:
            for part in slices(b):
                yield _scored(m, count, base, part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = materialize(
        read.where("cell is null").select("_k", "_h", "doc_id", "pieces", "level", "rare").mapInArrow(
            tidied(run),
            f"_k long, _h long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, "
            "rare array<struct<word: string, p: double>>",
        )
    )
    release(read)
    # rare words get their counts by a join; copies of a row share their key, so one stands for all
    rare = scored.dropDuplicates(["_k", "_h"]).select("_k", "_h", F.explode("rare").alias("x")).select("_k", "_h", "x.*")
    n = F.coalesce("n", F.lit(0))
    counted = (n + 1) / F.lit(float(base))
    mixed = F.lit(model.mix) * counted + F.lit(1 - model.mix) * F.exp("p")
    more = rare.join(words, "word", "left").groupBy("_k", "_h").agg(
        F.count_if(n > 0).alias("rare_known"), F.sum(F.log10(counted)).alias("rare_base"),
        F.sum(F.log10(mixed)).alias("rare_score"),
    )
    own = scored.drop("rare").join(more, ["_k", "_h"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )


def _scored(m: Model, top: np.ndarray, base: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """One batch of texts: the sums over common words, and the rare words with their probabilities."""
    p, (level, n_words) = _word_scores(m, part), _levels(part, top)
    common, first = level > 0, np.cumsum(n_words) - n_words
    counted = np.log((top + 1) / base)[level]
    mixed = np.logaddexp(np.log(m.mix) + counted, np.log1p(-m.mix) + p)
    sums = lambda of: np.add.reduceat(np.where(common, of, 0), first)
    rare = part.column("rare")
    words = pa.StructArray.from_arrays([rare.flatten(), pa.array(p[~common])], ["word", "p"])
    rare = pa.ListArray.from_arrays(pa.array(_edges(rare), pa.int32()), words)
    return pa.RecordBatch.from_arrays(
        [
            part.column("_k"), part.column("_h"), part.column("doc_id"), pa.array(n_words), pa.array(sums(1)),
            pa.array(sums(counted) / np.log(10)), pa.array(sums(mixed) / np.log(10)), rare,
        ],
        names=["_k", "_h", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
    )
