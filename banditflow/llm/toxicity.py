"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or.

A document is a bag of sentences.  A sentence has p = sigmoid(b + sum of its words' weights), the
document P = 1 - prod(1 - p).  Only documents have labels; the likelihood of P trains the
sentence model, so the sentences that make a document toxic are found without being marked.

A word's weight is that of the word itself plus those of its first 4, 5 and 6 letters, which reaches
words that the training rows do not have.  The model is fitted in numpy on a bounded sample of the
labelled rows (``max_each`` rows of each label, texts of at most ``max_bytes`` bytes, taken by a
hash of the id); every text is scored whole.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banditflow.llm.texts import map_texts

MAX_EACH, MAX_BYTES, MAX_FEATURES = 2000, 1 << 16, 100_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = "\"'`()[]{}<>|,;:*_-=+#/\\~^&%$@ \t"


def features(word: str) -> list[str]:
    """What a word counts as: itself ("=word") and its beginnings ("4", "5", "6" letters)."""
    w = word.strip(_EDGE)
    return ["=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n)] if w else []


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of the sentences of a lower-cased text; blank ones are left out."""
    out = []
    for m in _SENTENCE.finditer(text):
        if words := set(m.group().split()):
            out.append((m.start(), m.end(), words))
    return out


@dataclass
class Model:
    """Weights by feature, the bias, and the share of toxic rows (the score when nothing was learnt)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


def _telling(rows: list[tuple[str, int]], least: float) -> list[str]:
    """Features whose share of texts differs between the labels by ``least`` standard errors or more."""
    n = Counter(y for _, y in rows)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in rows:
        words = set(text.lower().replace("\n", " ").split())
        words |= {w.strip(".!?") for w in words}
        seen[y].update({f for w in words for f in features(w)})
    both = seen[0] + seen[1]
    names, k = list(both), np.array(list(both.values()), float)
    one = np.array([seen[1][f] for f in names], float)
    share = k / len(rows)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[1] + 1 / n[0]))
    z = np.abs(one / n[1] - (k - one) / n[0]) / spread
    order = [i for i in np.lexsort((names, -z)) if z[i] >= least and k[i] >= 3]
    return [names[i] for i in order[:MAX_FEATURES]]


def fit(rows: list[tuple[str, int]], steps: int = 200, rate: float = 0.2, l2: float = 1e-5, least: float = 4.0) -> Model:
    """Train on (text, label) rows by Adam, on the features that tell the labels apart.

    Without rows of both labels, or without such features, nothing can be learnt: every score is then 0.
    """
    labels = np.array([y for _, y in rows], float)
    if len(rows) == 0 or labels.min() == labels.max():
        return Model()
    names = _telling(rows, least)
    number = {f: i for i, f in enumerate(names)}
    if not names:
        return Model()
    words: dict[str, int] = {}
    of_word: list[list[int]] = []
    token, of_sentence, of_doc = [], [], []
    for d, (text, _) in enumerate(rows):
        for _, _, ws in sentences(text.lower()):
            for w in ws:
                if w not in words:
                    words[w] = len(of_word)
                    of_word.append([number[f] for f in features(w) if f in number])
                if of_word[words[w]]:
                    token.append(words[w])
                    of_sentence.append(len(of_doc))
            of_doc.append(d)
    w_of = np.repeat(np.arange(len(of_word)), [len(x) for x in of_word])
    f_of = np.array([f for x in of_word for f in x], np.int64)
    token, of_sentence, of_doc = (np.array(x, np.int64) for x in (token, of_sentence, of_doc))
    n_w, n_f, n_s, n_d = len(of_word), len(names), len(of_doc), len(rows)
    x = np.zeros(n_f + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        by_word = np.bincount(w_of, x[f_of], n_w)
        z = x[-1] + np.bincount(of_sentence, by_word[token], n_s)
        soft = np.logaddexp(0, z)  # -log(1 - p)
        total = np.maximum(np.bincount(of_doc, soft, n_d), 1e-9)
        slope = np.where(labels == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) / n_d
        by_sentence = slope[of_doc] / (1 + np.exp(-z))
        by_word = np.bincount(token, by_sentence[of_sentence], n_w)
        g = np.append(np.bincount(f_of, by_word[w_of], n_f), by_sentence.sum())
        g[:-1] += l2 * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(a) for f, a in zip(names, x) if abs(a) > 1e-4}, float(x[-1]))


class _Weights(dict):
    """word -> weight, filled on demand, emptied when it is full."""

    def __init__(self, model: Model, limit: int = 500_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        w = self[word] = self.model.word(word)
        return w


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows that are not held out: at most ``max_each`` ids of each label that have a text to learn from.

    An id with several labels is toxic when one of them says so; rows without an id or label teach nothing.
    Warns when the labels are of both kinds but the texts to learn from are not: every score is then 0.
    """
    known = (
        labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes))
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = [usable.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_each) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * max_each ids
    # of ids that come with many texts, the first in order of id and text hash: the same rows in every run
    rows = texts.join(picked, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", F.xxhash64("text")).limit(4 * max_each).collect()
    if len({r.toxic for r in rows}) < 2 and known.select("toxic").distinct().count() == 2:
        warnings.warn("toxicity: labels of both kinds, but texts to learn from of one at most; all scores will be 0", stacklevel=2)
    return fit([(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))])


def _places(text: str, low: str) -> Callable[[int], int]:
    """From places in the lower-cased text to places in the text: lower-casing may lengthen it."""
    if len(low) == len(text):
        return int
    begin = np.cumsum([0, *(len(c.lower()) for c in text)])
    return lambda i: int(np.searchsorted(begin, i))


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, offending: float = 0.5) -> DataFrame:
    """Add score (0 to 1) and offending (sentences of probability ``offending`` or more) to each row.

    A sentence has its start and end (characters) and score.  Null, empty and blank texts have score 0.
    Columns of ``docs`` named like a new one are replaced; rows repeat as they come.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    limit = float(np.log(offending / (1 - offending)))

    def start() -> Callable[[list], dict]:
        m = shared.value
        weight = _Weights(m)

        def work(texts: list) -> dict:
            scores, spans = [], []
            for t in texts:
                s = t.decode("utf-8", "replace")
                low = s.lower()
                found = sentences(low) if m.bias is not None else []
                z = np.array([m.bias + sum(map(weight.__getitem__, ws)) for _, _, ws in found])
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())) if found else 0.0)
                at = _places(s, low)
                spans.append([
                    {"start": at(found[i][0]), "end": at(found[i][1]), "score": float(1 / (1 + np.exp(-z[i])))}
                    for i in np.flatnonzero(z >= limit)
                ])
            return {"score": scores, "offending": spans}

        return work

    fields = [("score", "double"), ("offending", "array<struct<start:long,end:long,score:double>>")]
    return map_texts(docs, start, fields, keep=keep)


def toxicity_digest(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending."""
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
