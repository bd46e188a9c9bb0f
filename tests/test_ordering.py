import numpy as np
import pandas as pd

from banditflow.operators.ordering import global_index, key_index, running_sum


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.35, 7, rng.integers(0, 50, n))  # one hot key with a third of rows
    pdf = pd.DataFrame({"k": key.astype("int64"), "o": rng.permutation(n).astype("int64"), "v": rng.random(n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_global_index(spark):
    pdf, df = _frame(spark)
    got = global_index(df, "o", "idx").toPandas().sort_values("o")
    assert (got["idx"].to_numpy() == np.arange(len(pdf))).all()


def test_key_index_with_hot_key(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        pdf, df = _frame(spark)
        got = key_index(df, "k", "o", "seq").toPandas().sort_values(["k", "o"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = pdf.sort_values(["k", "o"]).groupby("k").cumcount().to_numpy()
    assert (got["seq"].to_numpy() == want).all()


def test_running_sum_two_level(spark):
    pdf, df = _frame(spark)
    got = running_sum(df, "o", ["v"], block=97).toPandas().sort_values("o")
    np.testing.assert_allclose(got["v_cum"].to_numpy(), pdf.sort_values("o")["v"].cumsum().to_numpy(), rtol=1e-9)
