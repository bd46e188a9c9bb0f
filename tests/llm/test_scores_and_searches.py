"""op4, op6, op7, op8 and op10 against brute force or held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from banditflow.llm import decontaminate, lm, sharding, topk, toxicity
from banditflow.llm.texts import LOWER



PATH = public_tokenizers.path("byte_bpe_50k.json")
SF01 = "/root/testdata/sf0.01"


# op4 ------------------------------------------------------------------------------------------------
def _bags(rng, n):
    rows = []
    for i in range(n):
        lines = [" ".join(f"w{rng.randrange(200)}" for _ in range(8)) for _ in range(rng.randint(1, 30))]
        toxic = i % 3 == 0
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] = lines[at] + " nasty" + rng.choice(["ly", "est", "ness"])
        rows.append((". ".join(lines) + ".", int(toxic), toxic and at))
    return rows


def test_sentences_are_found_from_document_labels():
    rng = random.Random(1)
    model = toxicity.fit([r[:2] for r in _bags(rng, 300)])
    fresh = _bags(rng, 200)
    for text, toxic, at in fresh:
        found = toxicity.sentences(text.lower())
        z = np.array([model.bias + sum(map(model.word, ws)) for _, _, ws in found])
        assert (-np.expm1(-np.logaddexp(0, z).sum()) >= 0.7) == bool(toxic)
        if toxic:
            assert z.argmax() == at


def test_fit_without_both_labels():
    assert toxicity.fit([]).bias is None and toxicity.fit([("a b", 1)]).bias is None


def test_scores(spark, nasty, texts, nothing):
    model = toxicity.Model({"=one": 20.0}, -9.0)
    rows = toxicity.toxicity_digest(toxicity.score_documents(nasty, model)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id in (8, 9):
            assert r.predicted == 1 and r.n_offending == 1
        if r.doc_id in (5, 6, 7):
            assert r.score == 0
    assert toxicity.score_documents(nothing, model).count() == 0
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert isinstance(toxicity.train(nasty, labels), toxicity.Model)
    assert toxicity.train(nothing, labels.limit(0)).bias is None


def test_labels_without_a_short_text_take_no_place_in_the_sample(spark):
    rng = random.Random(2)
    rows = [(i, text, toxic) for i, (text, toxic, _) in enumerate(_bags(rng, 300))]
    rows += [(i, "long " * 20_000, i % 2) for i in range(300, 320)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = [(i, y) for i, _, y in rows] + [(i, i % 2) for i in range(10_000, 14_000)]  # most have no document here
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    assert toxicity.train(docs, labels, max_each=60).word("nastyly") > 1
    with pytest.warns(UserWarning, match="both kinds"):
        assert toxicity.train(docs.where("doc_id % 3 > 0 and doc_id < 300"), labels).bias is None


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_digest(toxicity.score_documents(docs, toxicity.train(docs, labels), keep=["doc_id"]))
    rows = rows.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    clean = [r.predicted for r in rows if not r.toxic]
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(clean) / len(clean) < 0.02 and sum(toxic) / len(toxic) > 0.75


# op6 ------------------------------------------------------------------------------------------------
def test_words_form_a_distribution():
    """After any context the words' probabilities, each with its stop, add up to one."""
    rng = np.random.default_rng(0)
    size = 9  # subwords 0..3 begin words, 4..7 go on, 8 is the end
    begins = np.array([True] * 4 + [False] * 4 + [True])
    texts = [np.append(rng.integers(0, 8, rng.integers(1, 40)), 8) for _ in range(30)]
    texts = [np.append(np.where(np.arange(len(t) - 1) == 0, t[:-1] % 4, t[:-1]), 8) for t in texts]
    m = lm.fit(texts, begins, np.arange(1, size + 1, dtype=float), steps=30, batch=16)
    head = np.array([1, 5, 2])
    total = 0.0
    for first in range(4):
        for n in range(4):  # words of up to four subwords; longer ones have the rest
            for rest in np.ndindex(*(4,) * n):
                word = np.array([first, *(r + 4 for r in rest)])
                seq = np.concatenate((head, word, [8]))
                lens = np.array([2, 1, len(word)])
                total += math.exp(lm.word_scores(m, seq[:-1], lens, lm.predict(m, [seq])[0])[2])
    seq = np.append(head, 8)
    total += math.exp(lm.word_scores(m, head, np.array([2, 1]), lm.predict(m, [seq])[0])[2])  # the end
    assert 0.5 < total <= 1 + 1e-4


def test_each_token_once_with_causal_context():
    rng = np.random.default_rng(1)
    begins = np.array([True] * 4 + [False] * 4 + [True])
    texts = [np.append(rng.integers(0, 8, 50), 8) for _ in range(8)]
    m = lm.fit(texts, begins, np.ones(9), steps=20, batch=16)
    a = np.append(rng.integers(0, 8, 45), 8)
    b = a.copy()
    b[30] = (b[30] + 1) % 8
    (pa_, _), (pb, _) = lm.predict(m, [a, b])
    assert len(pa_) == len(a) and np.allclose(pa_[:30], pb[:30], atol=1e-5)
    together = lm.predict(m, [b, a, b])[1][0]
    assert np.allclose(together, pa_, atol=1e-5)  # neighbours in a batch change nothing


def _want(texts):
    words = [(d, (t or "").encode().translate(LOWER).split() + [b"\n"]) for d, t in texts]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, ws in words if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(
        (str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
        for d, ws in words
    )


def test_words_of_a_batch_are_found_and_encoded_once():
    _, encode = lm.loaded(PATH)
    size = len(lm.loaded(PATH)[0].bytes)
    given = [b" the THE\t cat\x0b\xff sat.\r\n", b"", b" \x0c ", "\u00c4 \u2028x the\u00a0cat".encode(), b"the cat", b"cat\xc3 \x00 "]

    class Once(dict):
        asked: list = []

        def learn(self, words):
            encode.learn(words)

        def __missing__(self, word):
            self.asked.append(word)
            return encode[word]

    code = Once()
    got = lm._parsed(code, given, size)
    assert max(Counter(code.asked).values()) == 1
    ids, lens = lm._inputs(encode, [lm._strings(t) for t in given], size)
    assert got.ids.tolist() == np.concatenate(ids).tolist() and got.sizes.tolist() == [len(x) for x in ids]
    assert [got.words[i] for i in got.word] == [w for t in given for w in [*lm._strings(t), lm.END]]
    assert got.lens.tolist() == [x for own in lens for x in [*own.tolist(), 1]]


def test_attention_by_classes_equals_attention_by_places():
    rng = np.random.default_rng(11)
    size = 60
    begins = np.arange(size) % 2 == 0
    texts = [np.append(rng.integers(0, size - 1, n), size - 1) for n in (1, 15, 16, 17, 40, 3)]
    m = lm.fit(texts, begins, np.ones(size), steps=5, batch=4)
    weight = np.exp(m.query @ m.key.T)
    weight[:, m.blank] = 0
    for t, (p, s) in zip(texts, lm.predict(m, texts)):
        c = np.concatenate(([m.blank] * lm.BLOCK, [m.blank + 1], m.cls[t]))
        for i in range(len(t)):
            at = i + lm.BLOCK
            keys = np.arange(at // lm.BLOCK * lm.BLOCK - lm.BLOCK, at + 1)
            w = weight[c[at], c[keys]] * np.exp(m.near[at - keys])
            z = (w @ m.value[c[keys]] / w.sum() + m.rest[c[at]]) @ m.out + m.bias
            z -= np.log(np.exp(z).sum())
            assert abs(p[i] - z[m.cls[t[i]]] - m.inside[t[i]]) < 1e-4
            assert abs(s[i] - np.log(np.exp(z[: lm.STARTS]).sum())) < 1e-4


def test_counts_and_base(nasty, texts, nothing):
    totals = []
    for head in (1 << 18, 20):  # all words common; most of them joined
        rows = lm.score_texts(nasty, PATH, head=head).collect()
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
        assert got == _want(texts)
        assert all(r.score < 0 for r in rows)
        totals.append(sum(r.score for r in rows))
    assert abs(totals[0] / totals[1] - 1) < 0.1  # the mixture's share is estimated from common words alone
    assert lm.score_texts(nothing, PATH).count() == 0


def test_model_beats_counts_on_held_out_texts(spark):
    rows = lm.score_texts(spark.read.parquet(f"{SF01}/documents.parquet"), PATH).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def _cycles(n, length):
    """Texts that walk round a circle of 40 words, each from its own place."""
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "mu", "ne") for b in ("la", "ro", "si", "te", "vu", "fa", "go", "hi")]
    return [(d, " ".join(words[(7 * d + i) % 40] for i in range(length))) for d in range(n)]


def test_long_texts_teach_the_attention_model(spark):
    df = spark.createDataFrame(_cycles(14, 9000), "doc_id long, text string")  # all over 32 KB
    rows = lm.score_texts(df, PATH).collect()
    assert any(r.held_out for r in rows)
    for r in rows:
        assert r.score > 0.8 * r.base_score


def test_every_place_of_every_training_text_is_dealt_once(spark, monkeypatch):
    texts = _cycles(30, 700) + [(100, "x"), (101, ""), (102, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    _, encode = lm.loaded(PATH)
    size = len(lm.loaded(PATH)[0].bytes) + 1
    whole = [lm._inputs(encode, [lm._strings((t or "").encode())], size - 1)[0][0] for _, t in texts]
    column = lm._columns(np.bincount(np.concatenate(whole), minlength=size))
    rows = lm._dealt(df, PATH, column).collect()
    pieces = [np.frombuffer(r.ids, "<u2") for r in rows if r.ids is not None]
    assert len(pieces) == sum(-(-len(t) // lm.PIECE) for t in whole)
    assert Counter(np.concatenate([p[lm.BLOCK + 1 :] for p in pieces]).tolist()) == Counter(np.concatenate(whole).tolist())
    company = np.zeros(size * lm.COMPANY, int)
    for r in rows:
        if r.cell is not None:
            company[r.cell] += r.n
    assert (company == sum(lm._company([t], column, window=100) for t in whole)).all()

    # several groups and rounds
    monkeypatch.setattr(lm, "GROUP", 5000)
    m = lm.start(company, np.array([t[:1] == b" " for t in lm.loaded(PATH)[0].bytes] + [True]), np.ones(size))
    trained = lm._trained(m, spark.createDataFrame([r for r in rows if r.ids is not None], lm._dealt(df, PATH, column).schema), 20_000)
    loss = [-np.mean(np.concatenate([p for p, _ in lm.predict(x, whole)])) for x in (m, trained)]
    assert loss[1] < loss[0] - 0.5


def test_texts_read_once_give_the_words_scores(spark):
    texts = ["The cat sat. " * 300, None, "", "Zqx\u00e4 \u2028x caterwauling the\u00a0cat \x00", "zqx the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    v, encode = lm.loaded(PATH)
    size = len(v.bytes) + 1
    own = [lm._strings((t or "").encode()) for t in texts]
    ids, lens = lm._inputs(encode, own, size - 1)
    counts = np.bincount(np.concatenate(ids), minlength=size)
    begins = np.array([t[:1] == b" " for t in v.bytes] + [True])
    m = lm.fit(ids, begins, counts.astype(float), steps=3, batch=8)
    known = lm._Counts({"the": 2, "cat": 1, lm.END: 2})
    read = lm.read_texts(df, PATH, lm._columns(counts), known, 3, F.lit(True), F.lit(False)).where("cell is null")
    part = read.toArrow().combine_chunks().to_batches()[0]
    for part in (part, part.slice(2)):
        at = part.column("doc_id").to_pylist()
        words = [w for i in at for w in [*own[i], lm.END]]
        level, n = lm._levels(part, np.array([0, 5, 9]))
        assert level.tolist() == [known[w] for w in words] and n.tolist() == [len(own[i]) + 1 for i in at]
        assert part.column("rare").flatten().to_pylist() == [w for w in words if not known[w]]
        want = np.concatenate([lm.word_scores(m, ids[i][:-1], lens[i], lm.predict(m, [ids[i]])[0]) for i in at])
        assert np.allclose(lm._word_scores(m, part), want, atol=1e-4)


def test_each_text_is_taken_apart_once_after_the_counts(spark):
    n = 1200
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        asked.add(1)
        return f"word{i % 50} the cat {i % 7}"

    df = spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    assert lm.score_texts(df, PATH).count() == n
    assert asked.value < 2.4 * n  # counted, then taken apart; some again to see whether any text is kept out


# op7 ------------------------------------------------------------------------------------------------
def _hits(texts, items, n=10):
    ok = lambda b: b >= 128 or chr(b).isalnum()
    words = lambda t: bytes(b if ok(b) else 32 for b in (t or "").encode().translate(LOWER)).split()
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for d, t in texts:
        ws, hit, found = words(t), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                if (x := windows.get(tuple(ws[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(ws), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


def test_contamination(spark, nasty, texts, nothing):
    twelve = dict((d, t) for d, t in texts if d)[12].split()
    items = [
        (1, " ".join(twelve[15:40]).upper()), (10, "One, TWO!"), (10, "six more words"), (2, ""), (3, None), (None, "ab" * 400),
        (5, " ".join(twelve[20:26])), (6, "no such words anywhere in here at all or so they say"), (1, " ".join(twelve[15:40])),
    ]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    want = _hits(texts, items)
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        found = decontaminate.find_contamination(nasty, bench, broadcast_words=limit)
        assert found.columns.count("n_words") == 1
        assert Counter(map(tuple, decontaminate.contamination_digest(found).collect())) == want
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    none = decontaminate.find_contamination(nasty, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)


# op8 ------------------------------------------------------------------------------------------------
def test_top_k(spark):
    rng = random.Random(3)
    vec = lambda n: [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(n)]
    rows = [(i, vec(6), 1, "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1, "x") for i in range(120)]  # a hot vector
    rows += [(2000, None, 1, "x"), (2001, [None] * 6, 1, "x"), (2002, [float("nan")] * 6, 1, "x"), (2003, [math.inf] * 6, 1, "x"), (2004, [1.0], 1, "x"), (None, vec(6), 1, "x"), (2050, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long, id string").repartition(5)
    v = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(v, v.where(F.col("id") % 50 == 0), k=5, pivots=12, block=40).collect()))
    use = {i: [math.floor(256 * x) for x in e] for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in (i for i in use if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(use[q], e)), i) for i, e in use.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    few = v.where(F.col("id").isin(0, 50, 51))
    assert topk.top_k(few, few.where("id = 50"), k=5).count() == 2
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


# op10 -----------------------------------------------------------------------------------------------
def test_sharding(nasty, texts, nothing):
    rows = sharding.shard_documents(nasty, [1.0] * 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts
    )
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.shard_documents(nothing, [1.0] * 16).count() == 0


def test_weights_and_moves(spark):
    df = spark.range(20000)
    weights = [1.0, 2.0, 0.0, 5.0]
    got = df.select(sharding.shard_of(F.col("id"), weights).alias("a"), sharding.shard_of(F.col("id"), [*weights, 2.0]).alias("b"))
    rows = got.collect()
    share = Counter(r.a for r in rows)
    assert share[2] == 0
    for i, w in enumerate(weights):
        assert abs(share[i] / 20000 - w / 8) < 0.02
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 4 for r in moved) and abs(len(moved) / 20000 - 0.2) < 0.02
    slots = sharding.with_slots(df.withColumn("shard", F.lit(0)), "shard", ["id"], bucket_rows=300).select("slot").collect()
    assert sorted(r.slot for r in slots) == list(range(20000))




def test_offending_places_hold_when_lower_casing_lengthens_a_text(spark):
    """Places are those of the text, not of its lower-cased form, and the score is the noisy-or of its sentences."""
    model = toxicity.Model({"=bad": 6.0, "=word": -2.0}, -3.0)
    texts = ["İİİ is fine. A BAD thing here! İ BAD BAD word.", "A bad thing.", "Iİ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for d, text in enumerate(texts):
        spans = [(text[s.start : s.end], s.score) for s in rows[d].offending]
        assert all("bad" in t.lower() for t, _ in spans)
        stay = 1.0
        for _, _, words in toxicity.sentences(text.lower()):
            z = model.bias + sum(model.word(w) for w in words)
            stay *= 1 - 1 / (1 + np.exp(-z))
        assert abs(rows[d].score - (1 - stay)) < 1e-9 if text else rows[d].score == 0
    assert [texts[0][s.start : s.end].strip() for s in rows[0].offending] == ["A BAD thing here", "İ BAD BAD word"]


def test_benchmark_index_is_small_and_quick():
    """4 MB of benchmark: built once, unpacked in a worker in seconds and tens of MB, every window found."""
    import pickle
    import time

    rng = np.random.default_rng(7)
    vocabulary = [f"w{i:x}" for i in range(60_000)]
    items = [(f"i{k}", " ".join(vocabulary[j] for j in rng.integers(0, 60_000, 700)).encode()) for k in range(1000)]
    assert sum(len(t) for _, t in items) > 3_900_000
    start = time.time()
    packed = decontaminate.build_index(items, 10)
    size = len(pickle.dumps(packed))
    built = time.time() - start
    start = time.time()
    index = decontaminate.WindowIndex(pickle.loads(pickle.dumps(packed)))
    assert built < 15 and time.time() - start < 5 and size < 50 << 20
    words = decontaminate.words_of(items[500][1])
    hit, found = index.scan([b"other"] * 7 + words[100:130] + [b"w5", b"nothing"])
    assert found == {"i500"} and hit.tolist() == [False] * 7 + [True] * 30 + [False] * 2


def test_shards_recomputed_from_their_hashes(spark):
    """Weighted rendezvous scores of every key, with the 64-bit hash computed outside Spark."""
    import math
    import struct

    import xxhash

    def shard(key, weights):
        best = (-1.0, 0)
        for i, w in enumerate(weights):
            if not w:
                continue
            seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed)
            u = ((h >> 11) + 0.5) / 2**53
            score = w / -math.log(u)
            if score > best[0]:
                best = (score, i)
        return best[1]

    rows = [(k, "x") for k in [*range(-300, 3000), 2**62, -(2**63)]] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for weights in ([1.0] * 16, [3.0, 0.0, 1.0, 0.5]):
        got = sharding.shard_documents(docs, weights).collect()
        grown = [*weights, sum(weights) / len(weights)]
        assert all((r.shard, r.grown_shard) == (shard(r.doc_id, weights), shard(r.doc_id, grown)) for r in got)
