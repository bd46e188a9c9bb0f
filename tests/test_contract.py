import __spark_entry__ as se


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["round_id", "cum_reward", "cum_random", "ratio"]
    assert df.count() == 1000


def test_every_oracle_has_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())
    assert "complete_edges" not in se.queries()  # the complete graph is never materialised


def test_every_oracle_plans_in_duckdb():
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings", "documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in se.oracle_sql().items():
        con.execute("EXPLAIN " + sql)
