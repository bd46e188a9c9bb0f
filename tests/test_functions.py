"""Column math (M1-M13, T1) against numpy on generated arrays."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from banditflow.functions import linalg as L
import bruteforce as bf

D = 3
vec = st.lists(st.floats(-5, 5, allow_nan=False, width=32), min_size=D, max_size=D)
row = st.tuples(vec, vec, st.integers(0, 10_000), st.integers(0, 10_000))


@settings(max_examples=5, deadline=None)
@given(st.lists(row, min_size=1, max_size=40))
def test_vector_functions(spark, rows):
    df = spark.createDataFrame(
        [([float(v) for v in a], [float(v) for v in b], t1, t2) for a, b, t1, t2 in rows],
        "a array<double>, b array<double>, t1 long, t2 long",
    )
    out = df.select(
        L.dot("a", "b").alias("dot"),
        L.l2_distance("a", "b").alias("l2"),
        L.outer("a").alias("outer"),
        L.average("a", "b").alias("avg"),
        L.cluster_bound("t1", "t2", 0.7).alias("cb"),
        L.exploration_beta("t1", D).alias("beta"),
        L.buffer_threshold("t1").alias("thr"),
        L.argmax("a").alias("am"),
    ).collect()
    for (a, b, t1, t2), r in zip(rows, out):
        a, b = np.asarray(a, float), np.asarray(b, float)
        assert np.isclose(r.dot, a @ b, atol=1e-9)
        assert np.isclose(r.l2, np.linalg.norm(a - b), atol=1e-9)
        assert np.allclose(r.outer, np.outer(a, a).ravel(), atol=1e-9)
        assert np.allclose(r.avg, (a + b) / 2)
        assert np.isclose(r.cb, bf.cb(t1, t2, 0.7))
        assert np.isclose(r.beta, np.sqrt(D * np.log(1 + t1) * np.sqrt(t1) + 1))
        assert np.isclose(r.thr, 4 * np.log(max(t1, 1)))
        assert r.am == int(np.argmax(a))  # first maximum on ties


def test_ucb_scores_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        arms = rng.normal(size=(4, D))
        m = rng.normal(size=(D, D))
        a_inv = np.linalg.inv(np.eye(D) + m @ m.T)
        theta = rng.normal(size=D)
        rows.append((arms.tolist(), theta.tolist(), a_inv.ravel().tolist(), int(rng.integers(0, 500))))
    df = spark.createDataFrame(rows, "arms array<array<double>>, theta array<double>, a_inv array<double>, t long")
    got = df.select(L.ucb_scores("arms", "theta", "a_inv", "t", 0.03, D).alias("s")).collect()
    for (arms, theta, a_inv, t), r in zip(rows, got):
        X, th, Ai = np.asarray(arms), np.asarray(theta), np.asarray(a_inv).reshape(D, D)
        beta = np.sqrt(D * np.log1p(t) * np.sqrt(t) + 1)
        want = X @ th + np.sqrt(t) * 0.03 * np.sqrt(beta * np.einsum("kd,de,ke->k", X, Ai, X))
        assert np.allclose(r.s, want, atol=1e-9)


def test_fifo_buffer(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    blk = lambda c: F.struct(L.outer(c).alias("A"), F.col("x").alias("b"))
    r = df.select(
        L.fifo_pop(F.array()).alias("empty_pop"),
        L.fifo_peek(F.array().cast("array<struct<A:array<double>,b:array<double>>>")).alias("empty_peek"),
        F.size(L.fifo_push(F.array(blk(F.col("x"))), blk(F.col("x")))).alias("n"),
    ).first()
    assert r.empty_pop == [] and r.empty_peek is None and r.n == 2
