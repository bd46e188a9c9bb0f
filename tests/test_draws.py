"""The seeded draws look independent and uniform; the fixtures read whole tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from banditflow.functions.draws import uniform_int
from banditflow.operators import gossip as GS
from banditflow.sources import fixtures as fx


def _chi2(counts, cells, n):
    return sum((counts.get(c, 0) - n / len(cells)) ** 2 / (n / len(cells)) for c in cells)


@pytest.mark.parametrize("k", [5, 51])
def test_uniform_and_independent(spark, k):
    n = 40_000
    df = spark.range(n).select("id", *[uniform_int(F.col("id"), k, s).alias(f"s{s}") for s in (0, 1, 2)])
    rows = [tuple(r)[1:] for r in df.orderBy("id").collect()]
    for s in range(3):
        draws = [r[s] for r in rows]
        assert _chi2(Counter(draws), range(k), n) < 2.5 * k + 10
        cells = [(i, j) for i in range(k) for j in range(k)]
        assert _chi2(Counter(zip(draws, draws[1:])), cells, n - 1) < k * k + 5 * (2 * k * k) ** 0.5
    for a, b in ((0, 1), (1, 2), (0, 2)):
        agree = sum(r[a] == r[b] for r in rows) / n
        assert abs(agree - 1 / k) < 5 * (1 / k / n) ** 0.5


def test_large_keys_do_not_repeat(spark):
    df = spark.range(1000).select(uniform_int(F.col("id"), 1 << 20).alias("a"), uniform_int(F.col("id") + 2147483647, 1 << 20).alias("b"))
    assert df.where("a = b").count() < 5


def test_partners_differ_between_seeds(spark):
    users = spark.range(15).withColumnRenamed("id", "user_id")
    pairs = [dict(map(tuple, GS.partner_pairs(users, seed=s).collect())) for s in range(3)]
    for p in pairs:
        assert sorted(p) == sorted(p.values()) == list(range(15))
        assert sum(a == b for a, b in p.items()) < 8
        assert len({(b - a) % 15 for a, b in p.items()}) > 3  # no rotation
    assert pairs[0] != pairs[1] != pairs[2]


def test_every_embedding_is_read_whole(spark):
    sf = "/root/testdata/sf0.1"
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    events = fx._events(spark, sf)
    used = events.select(F.explode(F.array(*[fx._vec_id(a) for a in range(fx.K)])).alias("v")).distinct().count()
    assert used == emb.count() == 2000
    row = emb.where("vec_id = 7").first()
    vec = fx._feature_vectors(spark, sf).where("vec_id = 7").first().vec
    assert vec == [sum(float(x) for x in row.embedding[16 * i : 16 * i + 16]) for i in range(4)]


def test_share_step_reaches_every_branch(spark):
    from banditflow.plans.registry import QUERIES

    rows = QUERIES["share_step"](spark, "/root/testdata/sf0.01").collect()
    seen = Counter((r.reset, r.averaged) for r in rows)
    assert all(seen[x] for x in ((True, False), (False, True), (False, False)))
