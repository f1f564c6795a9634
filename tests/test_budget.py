import pytest
from pyspark.sql import functions as F

from tests.conftest import files_df
from weighbridge import audit
from weighbridge.operators import budget as B

# The worked budget of one published report: two always-on files, seven skills
# shown (five in the compact view) and two more worth 1,218 tokens together.
WORKED = [
    ("AGENTS.md", 9141, "always"),
    ("CLAUDE.md", 2506, "always"),
    ("skills/x402/SKILL.md", 4123, "ondemand"),
    ("skills/qa/SKILL.md", 2250, "ondemand"),
    ("skills/remote-browser/SKILL.md", 1839, "ondemand"),
    ("browser_use/skills/browser-use/SKILL.md", 1145, "ondemand"),
    ("skills/browser-use/SKILL.md", 1145, "ondemand"),
    ("skills/a/SKILL.md", 700, "ondemand"),
    ("skills/b/SKILL.md", 518, "ondemand"),
]


def _entries(spark, rows, repo="r1"):
    df = spark.createDataFrame([(repo, lab, t, ld) for lab, t, ld in rows], "repo_id string, label string, tokens long, load string")
    return df.select(
        "repo_id", "label", "tokens", "load", F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("long").alias("own_tokens"), F.lit(None).cast("long").alias("imported_tokens"),
        F.lit(None).cast("long").alias("n_imports"), F.lit(0).alias("src_ord"), F.col("label").alias("file_path"),
        F.lit(None).cast("int").alias("server_ord"),
    )


def test_worked_totals_shares_and_topk(spark):
    e = _entries(spark, WORKED)
    repos = spark.createDataFrame([("r1",)], "repo_id string")
    t = B.budget_totals(repos, e, model="claude-opus").collect()[0]
    assert (t["always_on_tokens"], t["on_demand_tokens"], t["on_demand_count"]) == (11647, 11720, 7)
    assert t["window_pct"] == 5.8
    assert abs(t["est_cost_usd"] - 11647 / 1e6 * 5) < 1e-12
    shares = {r["label"]: r["share_pct"] for r in B.budget_share(e, B.budget_totals(repos, e)).collect()}
    assert [shares[x[0]] for x in WORKED[:7]] == [39, 11, 18, 10, 8, 5, 5]
    top = B.budget_top_on_demand(e).collect()
    rest = [r for r in top if r["label"] == "more"]
    assert len(rest) == 1 and (rest[0]["n_entries"], rest[0]["tokens"]) == (2, 1218)
    assert sorted(r["label"] for r in top if r["load"] == "ondemand" and r["label"] != "more") == sorted(x[0] for x in WORKED[2:7])


def test_rank_ties_keep_input_order(spark):
    rows = [("b.md", 10, "ondemand"), ("a.md", 10, "ondemand"), ("z.md", 5, "always"), ("c.md", 10, "always")]
    ranked = {r["label"]: r["rank"] for r in B.budget_rank(_entries(spark, rows)).collect()}
    assert ranked == {"c.md": 1, "z.md": 2, "a.md": 3, "b.md": 4}


def test_zero_total_and_unknown_model(spark):
    e = _entries(spark, [("a.md", 0, "always")])
    repos = spark.createDataFrame([("r1",), ("r2",)], "repo_id string")
    t = {r["repo_id"]: r for r in B.budget_totals(repos, e, model="nope").collect()}
    assert t["r1"]["est_cost_usd"] is None and t["r2"]["always_on_tokens"] == 0
    assert B.budget_share(e, B.budget_totals(repos, e)).collect()[0]["share_pct"] == 0


def test_weighing_by_bytes_shuffles_no_text(spark):
    import re

    rows = [("CLAUDE.md", "@a.md\n@b.TXT\nown"), ("a.md", "x" * 9), ("b.TXT", "y" * 5), ("c.md", "z"), ("m.py", "w")]
    a = audit(files_df(spark, rows), weigher="bytes4")
    tokens = a.token_table
    assert {(r["rel_path"], r["is_context"], r["tokens"]) for r in tokens.collect()} == {("CLAUDE.md", True, 4), ("a.md", False, 3), ("b.TXT", False, 2)}
    tokens.unpersist()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tokens.select("*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = re.findall(r"\) Exchange\s*\nInput[^\n]*", plan)
    assert shuffled and not [x for x in shuffled if "content#" in x]


def test_rows_read_by_several_sections_are_kept(spark):
    a = audit(files_df(spark, [("CLAUDE.md", "x")]), weigher="bytes4")
    assert a.health.is_cached and a.budget_entries.is_cached
    a.release()
    assert not a.health.storageLevel.useMemory and not a.budget_entries.storageLevel.useMemory


def test_totals_keep_neither_texts_nor_entries(spark):
    files = files_df(spark, [("CLAUDE.md", "@a.md\nown"), ("a.md", "x" * 9), (".mcp.json", '{"mcpServers":{"s":{"tools":[{"n":1}]}}}')])
    a = audit(files, weigher="bytes4")
    total = a.budget.first()["always_on_tokens"]
    assert total == 3 + 3 + 3
    assert a.context_rows.is_cached and "content" not in a.context_rows.columns
    assert not a.texts.is_cached and not a._entries.storageLevel.useMemory and not a._mcp_costs.storageLevel.useMemory
    assert sum(r["tokens"] for r in a.budget_entries.collect()) == total and a.budget.first()["always_on_tokens"] == total
    a.release()
    assert not a.context_rows.storageLevel.useMemory


def test_texts_are_kept_where_the_tokenizer_reads_them_too(spark):
    a = audit(files_df(spark, [("CLAUDE.md", "x y")]), weigher="bpe")
    assert a.texts.is_cached and a.context_rows.is_cached
    a.release()


def test_edges_sizes_and_weights_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [("CLAUDE.md", "@a.md\n@gone.md\nx"), ("a.md", "@sub/b.md\nbody"), ("sub/b.md", "four"), ("c.md", None), ("AGENTS.md", None), ("x.py", "@a.md")]
    a = audit(files_df(spark, rows).withColumn("content", F.udf(seen, "string")("content")), repos=spark.createDataFrame([("r1",)], "repo_id string"), weigher="bytes4")
    specs = sorted((r["src_path"], r["spec"], r["dst_exists"]) for r in a.edges.collect())
    assert specs == [("CLAUDE.md", "a.md", True), ("CLAUDE.md", "gone.md", False), ("a.md", "sub/b.md", True)]
    tokens = {(r["rel_path"], r["is_context"], r["tokens"]) for r in a.token_table.collect()}
    assert tokens == {("CLAUDE.md", True, 4), ("AGENTS.md", True, 0), ("a.md", False, 4), ("sub/b.md", False, 1)}
    assert [r["rel_path"] for r in a.context_errors.collect()] == ["AGENTS.md"]
    assert sorted((r["rel_path"], r["bytes"], r["lines"]) for r in a.context_rows.collect()) == [("AGENTS.md", None, None), ("CLAUDE.md", 16, 3)]
    assert read.value == 5  # x.py is in no import tree


def test_servers_are_parsed_while_imports_are_claimed(spark, monkeypatch):
    import threading

    from weighbridge.plans import audit as A

    begun, claim, servers = threading.Event(), A.claim_imports, A.mcp_servers
    monkeypatch.setattr(A, "mcp_servers", lambda *args: begun.set() or servers(*args))
    monkeypatch.setattr(A, "claim_imports", lambda *args: begun.wait(60) and claim(*args))
    files = [("CLAUDE.md", "@a.md\nown"), ("a.md", "x" * 9), (".mcp.json", '{"mcpServers":{"s":{"tools":[{"n":1}]}}}')]
    assert audit(files_df(spark, files), weigher="bytes4").budget.first()["always_on_tokens"] == 9

    def broken(*args):
        raise ValueError("no servers")

    monkeypatch.setattr(A, "mcp_servers", broken)
    with pytest.raises(ValueError, match="no servers"):
        audit(files_df(spark, files), weigher="bytes4").budget
