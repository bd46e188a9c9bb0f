"""The pipeline's stages, each on its own input, against brute force."""

import hashlib
import inspect
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from banditflow.llm import toxicity

from .test_dedup import components
from .test_scores_and_searches import _hits

SF001 = "/root/testdata/sf0.001"


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def cut(texts, length=100):
    """Texts without the bytes of strings that an earlier document or place has."""
    seen, out = set(), []
    for d, t in sorted(texts, key=lambda r: -(2**63) if r[0] is None else r[0]):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        out.append((d, bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return Counter(out)


def check_stages(spark, docs, sf_dir, items):
    (_, toxic), (_, near), (_, repeats), (_, leaks), (_, bpe) = corpus_pipeline.STAGES
    columns = docs.columns
    kept = toxic(spark, docs, sf_dir).cache()
    assert kept.columns == columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    assert kept.count() == scored.where("score < 0.7").count()
    once = near(spark, kept, sf_dir).cache()
    want = {(d) for d, _, c, k in components(texts_of(kept), 5) if k}
    assert {d for d, _ in texts_of(once)} == want
    rest = repeats(spark, once, sf_dir).cache()
    assert rest.columns == columns and Counter(texts_of(rest)) == cut(texts_of(once))
    assert all(r.n_chars == len(r.text) for r in rest.collect())
    clean = leaks(spark, rest, sf_dir).cache()
    hits = _hits(texts_of(rest), items)
    assert Counter(d for d, _ in texts_of(clean)) == Counter({h[0]: n for h, n in hits.items() if not h[5]})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe(spark, clean, sf_dir).collect()
    assert len(rows) == clean.count()
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "substring_dedup", "decontaminate", "bpe"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    assert corpus_pipeline.ORACLE_SQL is None


def test_small_corpus(spark):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    check_stages(spark, spark.read.parquet(f"{SF001}/documents.parquet"), SF001, items)


def test_nasty_rows(spark, nasty, nothing, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items = [(7, "one two three four five six seven eight nine ten eleven"), (8, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # rows that share an id are ordered by a hash of their texts: brute force knows one order only
    check_stages(spark, nasty.where("doc_id is null or doc_id not in (16, 17)"), str(tmp_path), items)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
