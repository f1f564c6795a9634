import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["repo_id", "n_files", "n_findings", "score", "grade", "no_context"]
    parts = {f"repo{r['p_partkey']:04d}" for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey").collect()}
    repos = parts | {"repo0000", "repo0001", "repo0002", "repo0003", "repo_none1", "repo_none2", "repo_none3"}
    assert {r["repo_id"] for r in rows} == repos and sum(not r["no_context"] for r in rows) == 4


def test_repository_names_are_never_cut(spark):
    from pyspark.sql import functions as F

    from weighbridge.sources.fixtures import _repo_of

    rows = spark.createDataFrame([(7,), (1000,), (10_000,), (123_456_789,)], "n long").select(_repo_of(F.col("n")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["repo0007", "repo1000", "repo10000", "repo123456789"]


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = {"q_token_count_bpe", "q_sarif"}
    own = {name for name in E.queries() if name.startswith("q_")}
    assert own - set(E.oracle_sql()) == rows_only
    assert set(E.oracle_sql()) <= set(E.queries())
