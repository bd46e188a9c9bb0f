"""op2 and op9 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from banditflow.llm import near_dup, substring_dedup
from banditflow.llm.texts import LOWER

from .conftest import SCHEMA, rows_of


def shingles(t, n):
    w = (t or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts, n):
    low = -(2**63)
    nodes = {}
    for d, t in texts:
        nodes.setdefault(low if d is None else d, []).append(shingles(t, n))
    parent = {d: d for d in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in nodes[a] for y in nodes[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    real = lambda d: None if d == low else d
    return Counter(
        (d, len(shingles(t, n)), real(find(low if d is None else d)), find(low if d is None else d) == (low if d is None else d))
        for d, t in texts
    )


def test_near_duplicates(nasty, texts):
    for n in (4, 5):
        assert Counter(map(tuple, near_dup.near_duplicates(nasty, n_words=n).collect())) == components(texts, n)


def test_near_duplicates_of_nothing(nothing):
    assert near_dup.near_duplicates(nothing).collect() == []


def test_chains_and_a_large_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = []
    for i in range(90):  # neighbours are near, the ends of the chain are not
        texts.append((1000 + i, " ".join(base)))
        base[rng.randrange(100)] = f"v{i}"
    line = " ".join(f"c{i}" for i in range(12))
    for i in range(80):  # a common line alone links nothing
        texts.append((i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))))
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    got = Counter(map(tuple, near_dup.near_duplicates(df, n_words=4, leaf=16).collect()))
    assert got == components(texts, 4)


def test_rows_of_one_id_join_its_classes(spark):
    """Ids whose rows lie in several classes, none of them the class's smallest id, or without words."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    texts = [(2, b), (5, a), (5, b), (9, a), (7, ""), (7, a + " x"), (12, None), (12, "alone with four words"), (13, ""), (None, b), (None, "")]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = Counter(map(tuple, near_dup.near_duplicates(df, n_words=4).collect()))
    assert got == components(texts, 4)
    assert {r[2] for r in got if r[0] in (2, 5, 9)} == {None}  # the null id has text b, too


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """Copies between 0.5 and 1 of one text, some of them near each other only, in crowds dealt into several blocks."""
    monkeypatch.setattr(near_dup, "HELD", 40)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 3, 6, 9))):
            words[at] = f"e{i}x{at}"
        texts.append((10 * i + 3, " ".join(words)))
        if i % 8 == 0:  # a copy near this one, not near the text
            words[rng.randrange(150)] = f"f{i}"
            texts.append((10 * i + 4, " ".join(words)))
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    seen = []
    keep = near_dup._crowd_links
    monkeypatch.setattr(near_dup, "_crowd_links", lambda *a: seen.append(1) or keep(*a))
    got = Counter(map(tuple, near_dup.near_duplicates(df, n_words=4, leaf=16).collect()))
    assert seen and got == components(texts, 4)


def missed(pairs, depth, seed=0):
    """Pairs of ideal minwise tokens, alike in each function with probability 0.8, that no leaf at ``depth`` holds together."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**32, (pairs, near_dup.COORDS), dtype=np.uint32)
    other = rng.integers(0, 2**32, x.shape, dtype=np.uint32)
    both = np.concatenate((x, np.where(rng.random(x.shape) < 0.8, x, other))).astype("<u4")
    doc = pa.array(np.arange(2 * pairs))
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in both]), doc, doc], names=["tokens", "doc", "n"])
    joined = np.zeros(pairs, bool)
    for rows in near_dup._roots(near_dup.TREES)(iter([batch])):
        for level in range(1, depth + 1):
            path, doc = rows.column("path").to_numpy(), rows.column("doc").to_numpy()
            order = np.lexsort((doc, doc % pairs, path))  # only nodes that both documents reach go on
            path, doc = path[order], doc[order]
            pair = np.flatnonzero((path[1:] == path[:-1]) & (doc[1:] == doc[:-1] + pairs))
            if level == depth:
                joined[doc[pair]] = True
                break
            at = np.concatenate((pair, pair + 1))
            columns = [pa.array(path[at]), pa.array(doc[at]), pa.array(doc[at]), pa.array([both[d].tobytes() for d in doc[at]])]
            rows = pa.concat_batches(list(near_dup._branch(iter([pa.RecordBatch.from_arrays(columns, names=["path", "doc", "n", "tokens"])]))))
    return int((~joined).sum())


def test_recall_of_crowded_nodes():
    assert missed(20_000, 4) <= 1


def test_sketches_follow_the_threshold(spark):
    rng = random.Random(11)
    texts = []
    for i in range(60):  # pairs of one-word shingle sets at 75 of 105, right above 70 percent
        words = [f"p{i}w{j}" for j in range(105)]
        texts += [(2 * i, " ".join(words[:90])), (2 * i + 1, " ".join(rng.sample(words[15:], 90)))]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    rows = near_dup.near_duplicates(df, n_words=1, percent=70, trees=24).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in rows)
    for percent in (50, 70, 80, 95):
        k = near_dup.sketch_bound(percent)
        equal = np.random.default_rng(percent).binomial(256, percent / 100, 10**6)
        assert (equal < k).mean() <= 1e-5 and (equal < k + 8).mean() > 1e-6


def repeats(texts, length):
    key = lambda r: (-(2**63) if r[0] is None else r[0])
    seen, out = set(), []
    for d, t in sorted(texts, key=key):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(nasty, texts):
    # rows that share an id are ordered by a hash: keep one of them here, and repeat another row
    once = [(d, t) for d, t in texts if d not in (16, 17)]
    df = nasty.where("doc_id is null or doc_id not in (16, 17)")
    got = substring_dedup.repeat_digest(substring_dedup.remove_repeats(df)).collect()
    assert Counter(map(tuple, got)) == repeats(once, 100)
    twice = substring_dedup.repeat_digest(substring_dedup.remove_repeats(df.unionAll(df.where("doc_id = 15")))).collect()
    assert Counter(map(tuple, twice)) == repeats(once, 100) + Counter({r: 1 for r in repeats(once, 100) if r[0] == 15})


def test_repeats_with_all_rows_and_columns(nasty, texts, nothing):
    got = substring_dedup.remove_repeats(nasty, as_text=True)
    assert got.count() == len(texts) and got.columns.count("rest") == 1
    assert {r.doc_id: r.rest for r in got.collect()}[2] == ""
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_repeats_of_low_variety(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab") * rng.choice((1, 60)) for _ in range(40))) for i in range(25)]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    for length in (40, 100):
        got = substring_dedup.repeat_digest(substring_dedup.remove_repeats(df, length=length)).collect()
        assert Counter(map(tuple, got)) == repeats(texts, length)


def test_pieces_of_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = [(1, part + "x" * 50 + part), (2, part[100:700]), (3, "q" + part)]
    monkeypatch.setattr(substring_dedup, "_CHUNK", 256)
    body = [t.encode() for _, t in texts]
    whole = [r for chunk in substring_dedup._pieces(body, 100) for r in chunk]
    assert {(i, at) for i, at, _ in whole} >= {(0, 0), (0, 256), (0, 512)}
    n = sum(len(p) - 99 for _, _, p in whole)
    assert n == sum(len(t) - 99 for t in body)  # each window once
