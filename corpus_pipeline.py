"""A training corpus out of ``documents``: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.llm import bpe, decontaminate, near_dup, substring_dedup, toxicity
from banditflow.session import ensure_checkpoint_dir, materialize

THRESHOLD = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns under names that no operator has."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in _others(docs)])


def _others(docs: DataFrame) -> list[tuple[int, str]]:
    return [(i, c) for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]


def _restored(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` in their order, those in ``new`` being computed anew."""
    names = {c: F.col(f"__c{i}") for i, c in _others(docs)} | new
    return df.select(*[names.get(c, F.col(c)).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below THRESHOLD stay; the model learns from ``labels``."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _restored(toxicity.score_documents(_plain(docs), model).where(F.col("score") < THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Of rows that share this doc_id and the text one stays.
    """
    ensure_checkpoint_dir(spark)
    kept = near_dup.near_duplicates(docs, n_words=5).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    rows = _plain(docs).withColumn("__h", F.xxhash64("text"))
    once = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["doc_id", "__h"])
    return _restored(once, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier document (or place) has are cut out of the texts."""
    ensure_checkpoint_dir(spark)
    rows = _plain(docs)
    found = substring_dedup.remove_repeats(rows, keep=[c for c in rows.columns if c != "text"], as_text=True)
    new = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("rest").cast(docs.schema["n_chars"].dataType)
    return _restored(found, docs, **new)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a ``benchmark`` item stay."""
    found = decontaminate.find_contamination(_plain(docs), _table(spark, sf_dir, "benchmark"))
    return _restored(found.where(F.col("n_hit") == 0), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids (little-endian uint32) of the texts, their number, and digests of them and of their text.

    A column of ``docs`` with the name of a new one is replaced.
    """
    new = {
        "ids": F.col("ids"),
        "n_tokens": F.floor(F.octet_length("ids") / 4).cast("long"),
        "ids_sha256": F.sha2(F.col("ids"), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }
    encoded = bpe.encode_texts(_plain(docs), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    old = {c: F.col(f"__c{i}") for i, c in _others(docs) if c not in new}
    kept = [old.get(c, F.col(c)).alias(c) for c in docs.columns if c not in new]
    return encoded.select(*kept, *[v.alias(c) for c, v in new.items()])


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", reject_contaminated),
    ("bpe", tokenise),
]

#: The classifier, the tokenizer and the groups of near duplicates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
