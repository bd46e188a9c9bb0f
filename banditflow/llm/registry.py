"""Queries opN_<name> and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banditflow.llm import bpe, conversation_trie, decontaminate, lm, near_dup, pii, sharding, structure_repair, substring_dedup, token_counts, tool_calls, topk, toxicity
from banditflow.session import ensure_checkpoint_dir, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all conversations with their results, in topological order, as canonical JSON."""
    calls, results = tool_calls.conversation_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8 or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), n_words=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by section, each document encoded once."""
    docs = _table(spark, sf_dir, "documents")
    return token_counts.section_digest(token_counts.count_tokens(docs, VOCABULARY, keep=["doc_id"]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a sentence model learnt from document labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    return toxicity.toxicity_digest(toxicity.score_documents(docs, model, keep=["doc_id"]))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again, with digests of both."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.token_digest(bpe.encode_texts(docs, VOCABULARY, keep=["doc_id"], decoded=True))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a self-attention model and under word counts."""
    return lm.score_texts(_table(spark, sf_dir, "documents"), VOCABULARY)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench, keep=["doc_id"]))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector among all others."""
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in a 100-byte string seen earlier in the corpus."""
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.repeat_digest(substring_dedup.remove_repeats(docs, keep=["doc_id"]))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight by rendezvous hashing of doc_id."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 16)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, plain and disguised, at offsets of the source text."""
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, rebuilt so that groups share their openings."""
    turns = materialize(conversation_trie.ordered_turns(_table(spark, sf_dir, "conversations")))
    return conversation_trie.prefix_nodes(materialize(conversation_trie.with_shared_openings(turns)), turns)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation, with its edit letters and a digest of what is left."""
    table = _table(spark, sf_dir, "conversations")
    return structure_repair.repair_summary(structure_repair.damaged(table), table)


QUERIES = {"op1_tool_calls": op1_tool_calls, "op2_near_dup": op2_near_dup, "op3_token_counts": op3_token_counts, "op4_toxicity": op4_toxicity, "op5_bpe": op5_bpe, "op6_lm": op6_lm, "op7_decontaminate": op7_decontaminate, "op8_topk": op8_topk, "op9_substring_dedup": op9_substring_dedup, "op10_sharding": op10_sharding, "op11_pii": op11_pii, "op12_prefix_trie": op12_prefix_trie, "op13_structure_repair": op13_structure_repair}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        ) WHERE rank <= 5
    """,
    # a prefix is the list of the digests of its turns; crc32 is computed bit by bit
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT DISTINCT c, ((c % 100) + 100) % 100 AS off,
                   xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                       lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))),
                       4294967295) % 6 AS h
            FROM t
        ), rebuilt AS (
            SELECT i.c, 0 AS part, b.pos, b.role, b.text FROM ids i JOIN t b ON b.c = i.c - i.off AND b.pos <= i.h
            UNION ALL
            SELECT i.c, 1, t.pos, t.role, t.text FROM ids i JOIN t ON t.c = i.c AND t.pos > i.h
        ), turns AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, length(text) AS chars,
                   md5(length(role) || ':' || role || text) AS t
            FROM rebuilt
        ), steps AS (
            SELECT c, d, chars, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS key FROM turns
        ), places AS (
            SELECT c, d, chars, key, left(key, 32 * (d::INT - 1)) AS up, max(d) OVER (PARTITION BY c) = d AS last FROM steps
            UNION ALL
            SELECT c, 0, 0, '', NULL, c NOT IN (SELECT c FROM steps) FROM ids
        ), nodes AS (
            SELECT key, min(d) AS d, min(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * min(chars) AS saved,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends
            FROM places GROUP BY key
        ), kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), below AS (
            SELECT p.key, sum((k.n IS NULL)::INT) AS leaves, sum(n.saved) AS saved
            FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN places p ON p.c = n.c AND p.d <= n.d GROUP BY p.key
        )
        SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
               b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
        FROM nodes n LEFT JOIN nodes u ON u.key = n.up LEFT JOIN kids k ON k.key = n.key JOIN below b ON b.key = n.key
    """,
}
