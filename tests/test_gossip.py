from pyspark.sql import functions as F

from banditflow.functions import linalg as L
from banditflow.operators import gossip as GS


def _agents(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, th0 double, t long, nbuf int")
    buf_el = F.struct(L.identity(2).alias("A"), L.zeros(2).alias("b"))
    return df.select(
        "user_id",
        F.transform(L.identity(2), lambda v: v * (F.col("user_id") + 1)).alias("cov"),
        F.array(F.col("th0"), F.lit(0.0)).alias("b"),
        L.identity(2).alias("cov_loc"),
        F.array(F.col("th0"), F.lit(0.0)).alias("b_loc"),
        "t",
        F.array_repeat(buf_el, F.col("nbuf")).alias("buf"),
    ), df.select("user_id", F.array(F.col("th0"), F.lit(0.0)).alias("theta"))


def test_share_rules(spark):
    # 0 and 1 are close (average), 2 is far from 3 (reset + cut)
    agents, theta = _agents(spark, [(0, 0.0, 100, 1), (1, 0.01, 100, 1), (2, 0.0, 100, 2), (3, 5.0, 100, 1)])
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    cuts = spark.createDataFrame([], "src long, dst long")
    new, cut = GS.share(agents, theta, pairs, None, 0.7, cuts=cuts)
    rows = {r.user_id: r for r in new.collect()}
    assert rows[0].averaged and rows[1].averaged
    assert rows[0].cov == [1.5, 0.0, 0.0, 1.5]
    assert rows[2].reset and rows[3].reset and rows[2].buf == []
    assert rows[2].cov == [1.0, 0.0, 0.0, 1.0]  # own local model
    assert {(min(r.src, r.dst), max(r.src, r.dst)) for r in cut.collect()} == {(2, 3)}


def test_partner_pairs_is_permutation(spark):
    users = spark.range(0, 40).withColumnRenamed("id", "user_id")
    p = GS.partner_pairs(users, seed=3).collect()
    assert sorted(r.src for r in p) == list(range(40))
    assert sorted(r.dst for r in p) == list(range(40))


def test_share_as_written(spark):
    """Q11 as written: a reset takes the partner's local model; every gossiped pair is cut."""
    agents, theta = _agents(spark, [(0, 0.0, 100, 1), (1, 0.01, 100, 1), (2, 0.0, 100, 2), (3, 5.0, 100, 1)])
    agents = agents.withColumn("cov_loc", F.transform(L.identity(2), lambda v: v * (F.col("user_id") + 10)))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    cuts = spark.createDataFrame([], "src long, dst long")
    new, cut = GS.share(agents, theta, pairs, None, 0.7, as_written=True, cuts=cuts)
    rows = {r.user_id: r for r in new.collect()}
    assert rows[2].reset and rows[2].cov == [13.0, 0.0, 0.0, 13.0]  # partner 3's local model
    assert {(min(r.src, r.dst), max(r.src, r.dst)) for r in cut.collect()} == {(0, 1), (2, 3)}
