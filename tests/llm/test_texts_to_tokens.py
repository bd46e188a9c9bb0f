"""op5 and op3 against the tokenizers library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from banditflow.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
V, ENCODE = bpe.loaded(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def same(texts):
    for t, got in zip(texts, ENCODE.many(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, t[:60]
        assert bpe.decode_ids(V, got, block=3) == LIBRARY.decode(want, skip_special_tokens=False)


def test_random_mixtures():
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'", "the", "ing", "é", "1", "23", "<|endoftext|>", "<|", "　", "\x85", "x" * 40, "!", "\r\n", "🙂", "中文", "Word", ".\nNext"]
    same(["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)])


def test_long_runs_stream():
    rng = random.Random(2)
    same(["a" * 9000, "ab" * 6000, " " * 5000, "\n" * 6000 + "x", "".join(rng.choice("etaoinshrdlu") for _ in range(20000)), "é" * 5000, "=" * 5000])


def test_lookahead_of_a_small_merge_list():
    # (a,b), (b,c): a b | c: "ab" is sure once b is there; b may take c unless a took it
    assert bpe.sufficient_lookahead([(0, 1, 3), (1, 2, 4)], [1, 1, 1, 2, 2]) >= 1
    assert V.lookahead < 1000


def test_pieces_of_any_size():
    data = ("".join(random.Random(3).choice("aeiounrst") for _ in range(6000))).encode()
    whole = bpe.merge_bytes(V, data)
    for size in (1, 7, 1000):
        chunks = (data[i : i + size] for i in range(0, len(data), size))
        assert list(bpe.iter_tokens(V, chunks)) == whole


def test_operator(nasty, texts, nothing):
    got = bpe.token_digest(bpe.encode_texts(nasty, PATH, keep=["doc_id"], decoded=True)).collect()
    want = []
    for d, t in texts:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    encoded = bpe.encode_texts(nasty, PATH)
    assert encoded.columns.count("ids") == 1 and encoded.schema["ids"].dataType.simpleString() == "binary"
    assert bpe.token_digest(bpe.encode_texts(nothing, PATH, decoded=True)).count() == 0


def test_attribution_rules():
    ends, bounds = np.array([2, 5, 9]), np.array([0, 4, 4, 9])
    assert token_counts.attribute(ends, bounds, "first").tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, bounds, "most").tolist() == [2, 0, 1]  # 2 bytes of 3 lie in the first
    assert np.allclose(token_counts.attribute(ends, bounds, "share"), [1 + 2 / 3, 0, 1 + 1 / 3])
    tie = token_counts.attribute(np.array([4]), np.array([0, 2, 4]), "most")
    assert tie.tolist() == [1, 0]  # the earlier one of two halves


def test_sections_add_up(nasty, texts, nothing):
    for rule in token_counts.RULES:
        rows = token_counts.count_tokens(nasty, PATH, rule=rule, keep=["doc_id"]).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert abs(sum(s.tokens for s in r.sections) - r.n_tokens) < 1e-6
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].sections == [] and by_id[5].n_tokens == 0
    one = by_id[13]
    assert [s.kind for s in one.sections] == ["head", "break", "tail"]
    assert token_counts.section_digest(token_counts.count_tokens(nothing, PATH)).count() == 0


def test_offsets_against_the_library(texts):
    for _, t in texts:
        if t and t.isascii():
            e = LIBRARY.encode(t, add_special_tokens=False)
            ends = token_counts.token_ends(V, next(ENCODE.many([t])))
            assert ends.tolist()[-1] == len(t)
            # the library's spans leave a leading space out; ends are the same
            assert ends.tolist() == [o[1] for o in e.offsets]


def test_fields(nasty, texts, nothing):
    rows = token_counts.count_fields(nasty, PATH, ["source", "text"]).collect()
    assert len(rows) == 3 * len(texts)
    total = sum(r.n_tokens for r in rows)
    assert total == sum(len(LIBRARY.encode("src0\n" + (t or ""), add_special_tokens=False).ids) for _, t in texts)
    assert token_counts.count_fields(nothing, PATH, ["source", "text"]).count() == 0


def test_sections_of_invalid_bytes(spark):
    """Bytes that are no UTF-8 count as U+FFFD, in the tokens as in the places."""
    docs = spark.createDataFrame([(1, bytearray(b"ab \xff")), (2, bytearray(b"\xe2\x82\nx\n\nlast \xf0\x9f")), (3, None)], "doc_id long, text binary")
    for rule in token_counts.RULES:
        rows = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH, rule=rule).collect()}
        assert rows[3].sections == []
        for i, raw in ((1, b"ab \xff"), (2, b"\xe2\x82\nx\n\nlast \xf0\x9f")):
            text = raw.decode("utf-8", "replace")
            assert rows[i].sections[-1].end == len(text.encode())
            assert rows[i].n_tokens == len(LIBRARY.encode(text, add_special_tokens=False).ids)
            assert abs(sum(s.tokens for s in rows[i].sections) - rows[i].n_tokens) < 1e-6


def _small_vocabulary(rng, letters, n_merges):
    """A random merge list over single bytes: each merge joins two tokens there are, and makes a new one."""
    from types import SimpleNamespace

    tokens = [bytes([b]) for b in range(256)]
    known, merges = set(tokens), []
    parts = [tokens[ord(c)] for c in letters]
    while len(merges) < n_merges:
        a, b = rng.choice(parts), rng.choice(parts)
        if len(a + b) > 7 or a + b in known:
            continue
        merges.append((tokens.index(a), tokens.index(b), len(tokens)))
        tokens.append(a + b)
        known.add(a + b)
        parts.append(a + b)
    v = SimpleNamespace(
        bytes=tokens, of_byte=list(range(256)), rank={(a, b): r for r, (a, b, _) in enumerate(merges)}, made=[c for *_, c in merges]
    )
    v.lookahead = bpe.sufficient_lookahead(merges, [len(t) for t in tokens])
    return v


def test_lookahead_suffices_for_every_short_string():
    """Random merge lists: byte by byte, with the computed lookahead only, every string over two letters up to 11 bytes."""
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(25):
        v = _small_vocabulary(rng, "ab", rng.randint(2, 9))
        for n in range(1, 12):
            for s in itertools.product(b"ab", repeat=n):
                data = bytes(s)
                run = bpe.RunEncoder(v, block=1)
                run.block = v.lookahead + 1  # emit as early as the lookahead allows
                got = [t for b in data for t in run.push(bytes([b]))] + run.finish()
                assert got == bpe.merge_bytes(v, data), (data, v.rank, v.lookahead)
