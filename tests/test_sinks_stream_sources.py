import json
import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import files_df
from weighbridge import audit
from weighbridge.sinks import ResultStore, read_documents, report_documents, report_lines, sarif_lines, scan_result_documents, write_documents
from weighbridge.sources.readers import read_scan_results
from weighbridge.sources.tree import register
from weighbridge.streaming import incremental_scan, pending_repos


def _audit(spark):
    files = files_df(spark, [("CLAUDE.md", "@gone.md\n" + "\n" * 201), ("AGENTS.md", "ok")]).unionByName(
        files_df(spark, [("README.md", "no context")], repo="r_none")
    ).unionByName(files_df(spark, [("CLAUDE.md", "clean")], repo="r_clean"))
    return audit(files, weigher="bytes4")


def _assembled(path):
    """Each written document, its part files one after another in the order of their names."""
    out = {}
    for folder in sorted(os.listdir(path)):
        if folder.startswith("repo_id="):
            names = sorted((n for n in os.listdir(os.path.join(path, folder)) if n.startswith("part-")), key=lambda n: (len(n), n))
            out[folder[8:]] = "".join(open(os.path.join(path, folder, n)).read() for n in names)
    return out


def test_sarif_one_document_per_repository(spark):
    a = _audit(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="wb-sarif-"), "sarif")
    write_documents(sarif_lines(a.findings, a.health), out)
    docs = {repo: json.loads(text) for repo, text in _assembled(out).items()}
    assert set(docs) == {"r1", "r_none", "r_clean"}
    run = docs["r1"]["runs"][0]
    assert docs["r1"]["version"] == "2.1.0" and "$schema" in docs["r1"]
    assert run["results"][0]["ruleId"] == "budget/too-long" and run["results"][0]["level"] == "warning"
    assert run["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "CLAUDE.md"}}
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["budget/too-long", "imports/unresolved"]
    assert "invocations" not in run and run["results"][1]["level"] == "note"
    na = docs["r_none"]["runs"][0]
    assert na["results"] == [] and na["invocations"][0]["toolExecutionNotifications"][0]["level"] == "note"
    clean = docs["r_clean"]["runs"][0]
    assert clean["results"] == [] and clean["tool"]["driver"]["rules"] == [] and "invocations" not in clean


def test_documents_split_over_many_files_keep_their_order(spark):
    from pyspark.sql import functions as F

    from weighbridge.sinks.documents import document_lines, listed, once, repository

    repos = spark.createDataFrame([("big/one",), ("007",), ("none",)], "repo_id string")
    items = spark.range(5000).select(F.when(F.col("id") % 50 > 0, "big/one").otherwise("007").alias("repo_id"), F.col("id")).repartition(7)
    lines = document_lines(once(repos, F.concat(F.lit("{"), repository(), F.lit(',"n":['))), listed(items, F.to_json(F.struct("id")), [F.col("id")]), once(repos, F.lit("]}")))
    out = os.path.join(tempfile.mkdtemp(prefix="wb-doc-"), "d")
    write_documents(lines, out, lines_per_file=300)
    docs = {repo: json.loads(text) for repo, text in _assembled(out).items()}
    want = {"big%2Fone": [i for i in range(5000) if i % 50], "007": list(range(0, 5000, 50)), "none": []}
    assert {k: [x["id"] for x in d["n"]] for k, d in docs.items()} == want
    assert len([n for n in os.listdir(os.path.join(out, "repo_id=big%2Fone")) if n.startswith("part-")]) >= 16
    assert {d["repository"] for d in docs.values()} == {"big/one", "007", "none"}
    odd = lines.withColumn("repo_id", F.when(F.col("repo_id") == "none", 'q"\\é\n').otherwise(F.col("repo_id")))
    odd = odd.withColumn("line", F.when((F.col("section") == 0) & (F.col("repo_id") == 'q"\\é\n'), F.concat(F.lit("{"), repository(), F.lit(',"n":['))).otherwise(F.col("line")))
    bundle = out + "-bundle"
    write_documents(odd, bundle, by_repository=False, lines_per_file=37)
    back = {}
    for r in read_documents(spark, bundle).orderBy("repo_id", "position").collect():
        back.setdefault(r["repo_id"], []).append(r)
    assert {k: len(v) for k, v in back.items()} == {"big/one": 4902, "007": 102, 'q"\\é\n': 2}
    for repo, rows in back.items():
        assert [r["position"] for r in rows] == list(range(len(rows)))
        assert json.loads("".join(r["line"] for r in rows))["repository"] == repo
    assert json.loads("".join(r["line"] for r in back["big/one"]))["n"] == [{"id": i} for i in want["big%2Fone"]]


def test_report_payload_has_findings_entries_and_imports(spark):
    rows = [
        ("CLAUDE.md", "@docs/b.md\n@docs/a.md\n@gone.md\n" + "\n" * 201), ("AGENTS.md", 'say "hi"'), ("docs/a.md", "a" * 40), ("docs/b.md", "b" * 80), ("s/SKILL.md", "x"),
        (".mcp.json", '{"mcpServers":{"m":{"command":"x"}}}'),
    ]
    files = files_df(spark, rows).unionByName(files_df(spark, [("README.md", "no context")], repo="r_none"))
    a = audit(files, weigher="bytes4", model="claude-opus")
    out = os.path.join(tempfile.mkdtemp(prefix="wb-report-"), "report")
    write_documents(report_lines(a), out)
    docs = {repo: json.loads(text) for repo, text in _assembled(out).items()}
    one, none = docs["r1"], docs["r_none"]
    assert [f["relPath"] for f in one["health"]["files"]] == ["AGENTS.md", "CLAUDE.md", "s/SKILL.md"]
    assert [f["code"] for f in one["health"]["findings"]] == ["budget/too-long", "imports/unresolved"] and one["health"]["grade"] == "A"
    entries = one["budget"]["entries"]
    assert [e["label"] for e in entries] == ["CLAUDE.md", "AGENTS.md", "mcp:m (schemas)", "s/SKILL.md"]
    assert entries[0]["imports"] == ["docs/a.md", "docs/b.md"] and entries[0]["importedTokens"] == 30 and "imports" not in entries[1]
    assert entries[2]["note"] and one["budget"]["onDemandCount"] == 1 and one["budget"]["estCostUsd"] > 0
    assert none == {
        "repository": "r_none",
        "health": {"grade": "N/A", "score": None, "noContext": True, "files": [], "findings": []},
        "budget": {"alwaysOnTokens": 0, "onDemandTokens": 0, "onDemandCount": 0, "contextWindow": 200000, "estCostUsd": 0.0, "entries": []},
    }


def test_result_store_keeps_one_result_of_several_writers(spark):
    from pyspark.sql import functions as F

    store = ResultStore(spark, os.path.join(tempfile.mkdtemp(prefix="wb-store-"), "s"))
    assert store.done().collect() == [] and store.results().count() == 0 and store.findings().count() == 0
    a = _audit(spark)
    results = a.scan_results("2026-07-02T00:00:00Z")
    store.write(results.where("repo_id = 'r1'"), a.findings)
    later = results.withColumn("grade", F.lit("Z"))
    store.write(later, a.findings.unionByName(a.findings))  # r1 has a result; the others have none yet
    assert {r["repo_id"]: r["grade"] for r in store.results().collect()} == {"r1": "A", "r_none": "Z", "r_clean": "Z"}
    assert sorted(r["code"] for r in store.findings().collect()) == ["budget/too-long", "imports/unresolved"]
    # an attempt that died before its log file, and a log file that died before its content, count never
    other = ResultStore(spark, store.path)
    other._commit = lambda attempt: None
    other.write(results.withColumn("repo_id", F.concat(F.lit("x"), F.col("repo_id"))), a.findings)
    open(os.path.join(store.path, "log", f"{2:020d}.json"), "w").close()
    assert store.results().count() == 3
    store.write(results.withColumn("repo_id", F.lit("r9")).limit(1), a.findings.limit(0))
    assert sorted(os.listdir(os.path.join(store.path, "log")))[-1] == f"{3:020d}.json" and store.done().count() == 4
    # two writers that saw the same log: the file is created once, the second takes the next number
    jvm = spark._jvm
    first = jvm.org.apache.hadoop.fs.Path(f"{store.path}/log/{4:020d}.json")
    first.getFileSystem(spark._jsc.hadoopConfiguration()).create(first, False).close()
    store._commit("late")
    assert "late" in open(os.path.join(store.path, "log", f"{5:020d}.json")).read()


def test_json_reports_and_scan_results_roundtrip(spark):
    a = _audit(spark)
    rep = {r["repo_id"]: json.loads(r["json"]) for r in report_documents(a).collect()}
    assert rep["r_none"]["health"]["grade"] == "N/A" and rep["r1"]["health"]["nFindings"] == 2 and rep["r_none"]["health"]["score"] is None
    out = tempfile.mkdtemp(prefix="wb-results-")
    docs = scan_result_documents(a.scan_results("2026-07-02T00:00:00Z"), a.findings)
    docs.write.mode("overwrite").json(out)
    back = {r["repo"]: r for r in read_scan_results(spark, out, multi_line=False).collect()}
    assert back["r1"]["report"]["health"]["findings"][0]["code"] in ("budget/too-long", "imports/unresolved")
    assert back["r_none"]["status"] == "n/a"
    urls = spark.createDataFrame([("r1", "https://host/o/r1", "abc123")], "repo_id string, url string, commit string")
    docs = scan_result_documents(a.scan_results("2026-07-02T00:00:00Z", urls), a.findings)
    assert {r["repo"]: r["commit"] for r in docs.collect()}["r1"] == "abc123"


def test_tree_source_reads_dotfiles(spark):
    root = tempfile.mkdtemp(prefix="wb-tree-")
    for rel, text in [("a/.cursorrules", "rule"), ("a/.github/copilot-instructions.md", "hi"), ("b/_x/CLAUDE.md", "c"), ("b/bad.md", None)]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(text.encode() if text is not None else b"\xff\xfeok")
    register(spark)
    rows = {(r["repo_id"], r["rel_path"]): r["content"] for r in spark.read.format("weighbridge_tree").load(root).collect()}
    assert rows[("a", ".cursorrules")] == "rule" and rows[("b", "_x/CLAUDE.md")] == "c"
    assert rows[("b", "bad.md")] == "��ok"
    assert ("a", ".github/copilot-instructions.md") in rows


def test_tree_source_splits_a_repository_and_skips_unaudited_names(spark):
    root = tempfile.mkdtemp(prefix="wb-tree-")
    want = {f"p{i}/d{j}/{name}" for i in range(5) for j in range(2) for name in ("CLAUDE.md", ".mcp.json", ".cursorrules")} | {"AGENTS.md", "p0/n.MD"}
    for rel in want | {"p0/logo.png", "p1/d0/main.py"}:
        os.makedirs(os.path.dirname(os.path.join(root, "mono", rel)), exist_ok=True)
        with open(os.path.join(root, "mono", rel), "w") as fh:
            fh.write("x")
    register(spark)
    for depth, tasks in (("0", 1), ("1", 6), ("2", 16)):
        df = spark.read.format("weighbridge_tree").option("depth", depth).option("only", "audit").load(root)
        assert df.rdd.getNumPartitions() == tasks
        assert sorted(r["rel_path"] for r in df.collect()) == sorted(want)
    assert spark.read.format("weighbridge_tree").option("partitions", "3").load(root).count() == len(want) + 2


def test_large_trees_are_listed_and_read_by_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weighbridge.sources import tree

    root, want = tempfile.mkdtemp(prefix="wb-tree-"), {}

    def put(rel, data):
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
        repo, path = rel.split("/", 1)
        want[repo, path] = data.decode("utf-8", errors="replace")

    for i in range(40):
        put(f"mono/p{i % 4}/q{i}/.cursor/rules/r{i}.mdc", b"x" * (i * 500))
        put(f"mono/p{i % 4}/q{i}/.mcp.json", b"{}")
    put("mono/" + "/".join(["deep"] * 60) + "/CLAUDE.md", b"deep")
    put("small/_x/bad.md", b"\xff\xfeok")
    put("small/logo.png", b"\x00" * 9000)
    os.symlink(os.path.join(root, "mono"), os.path.join(root, "small", "link"))
    os.makedirs(os.path.join(root, "empty"))
    scans, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: scans.append(str(p)) or scandir(p))
    listed = tree.list_tree(spark, root, folders=16)
    assert [p for p in scans if p.startswith(root)] == [root]  # the driver lists the root alone
    assert {(r["repo_id"], r["rel_path"]): r["bytes"] for r in listed.collect()}.keys() == want.keys()
    df = tree.read_tree(spark, root, piece_bytes=40_000, folders=16)
    got = {(r["repo_id"], r["rel_path"]): r["content"] for r in df.collect()}
    assert got == want
    per_task = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.sum(F.length("content") + tree.FILE_BYTES).alias("n")).collect()]
    assert len(per_task) > 10 and max(per_task) < 80_000
    audited = tree.read_tree(spark, root, only="audit")
    assert {r["rel_path"] for r in audited.collect()} == {p for _, p in want} - {"logo.png"}
    assert tree.read_tree(spark, tempfile.mkdtemp(prefix="wb-none-")).collect() == []


def test_incremental_scan_batch_and_stream(spark):
    snap, man = tempfile.mkdtemp(prefix="wb-snap-"), tempfile.mkdtemp(prefix="wb-man-")
    res = os.path.join(tempfile.mkdtemp(prefix="wb-res-"), "results")
    store = ResultStore(spark, res)

    def files(repo, rows):
        before = set(os.listdir(snap))
        files_df(spark, rows, repo=repo).coalesce(1).write.mode("append").parquet(snap)
        return [n for n in os.listdir(snap) if n.endswith(".parquet") and n not in before]

    def listed(repo, n_files):
        spark.createDataFrame([(repo, n_files)], "repo_id string, n_files long").coalesce(1).write.mode("append").parquet(man)

    def scan():
        incremental_scan(spark, snap, man, res, "2026-07-02T00:00:00Z", weigher="bytes4")
        return {r["repo_id"]: r["always_on_tokens"] for r in store.results().collect()}

    listed("r1", 1)
    first = files("r1", [("CLAUDE.md", "one " * 4)])
    listed("r2", 2)
    files("r2", [("AGENTS.md", "two " * 4)])  # its second file is still to come
    assert scan() == {"r1": 4}
    assert scan() == {"r1": 4}  # nothing new
    with open(os.path.join(snap, first[0]), "wb") as fh:
        fh.write(b"PAR1 no longer a table")  # a finished repository is not read again
    os.remove(os.path.join(snap, f".{first[0]}.crc"))
    files("r2", [("a/AGENTS.md", "more" * 4)])  # a file after the last manifest row wakes its repository
    assert scan() == {"r1": 4, "r2": 8}
    files("r3", [("CLAUDE.md", "three" * 4), ("CLAUDE.md", "three" * 4)][:1])
    files("r4", [("README.md", "none")])
    assert scan() == {"r1": 4, "r2": 8}  # files without a manifest row wait
    listed("r3", 1)
    listed("r4", 1)
    listed("r5", 0)
    assert scan() == {"r1": 4, "r2": 8, "r3": 5, "r4": 0, "r5": 0}

    # a batch whose end was not recorded runs again: same rows, no second result
    commits = os.path.join(res, "_stream", "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(os.path.join(commits, last))
    if os.path.exists(os.path.join(commits, f".{last}.crc")):
        os.remove(os.path.join(commits, f".{last}.crc"))
    logged = len(os.listdir(os.path.join(res, "log")))
    assert scan() == {"r1": 4, "r2": 8, "r3": 5, "r4": 0, "r5": 0}
    assert len(os.listdir(os.path.join(res, "log"))) == logged
    versions = [n for n in os.listdir(os.path.join(res, "_pending")) if n.startswith("v=")]
    assert len(versions) <= 2

    repos = spark.createDataFrame([("r1",), ("r2",), ("r9",)], "repo_id string")
    assert [r[0] for r in pending_repos(repos, store.done()).collect()] == ["r9"]


def test_replay_after_a_crash_between_results_and_pending_keys(spark, monkeypatch):
    from weighbridge.streaming import incremental

    root = tempfile.mkdtemp(prefix="wb-crash-")
    source = os.path.join(root, "snap")
    files_df(spark, [("CLAUDE.md", "one " * 4)]).coalesce(1).write.parquet(source)
    name = spark.read.parquet(source).select("_metadata.file_path").first()[0]
    rows = [("r1", 1, None, None), ("r1", None, "CLAUDE.md", name), ("r2", 1, None, None)]
    batch = spark.createDataFrame(rows, incremental.PENDING_SCHEMA)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental.PendingTable, "store", crash)
        try:
            incremental.scan_arrivals(batch, 0, f"{root}/res", "2026-07-02T00:00:00Z", weigher="bytes4")
        except RuntimeError:
            pass
    incremental.scan_arrivals(batch, 0, f"{root}/res", "2026-07-02T00:00:00Z", weigher="bytes4")
    store = ResultStore(spark, f"{root}/res")
    assert [(r["repo_id"], r["always_on_tokens"]) for r in store.results().collect()] == [("r1", 4)]
    assert len(os.listdir(f"{root}/res/results")) == 1
    table = incremental.PendingTable(spark, f"{root}/res/_pending")
    assert [tuple(r) for r in table.before(1).collect()] == [("r2", 1, None, None)]


def test_write_lines(spark):
    from weighbridge.sinks.json_report import finding_lines
    from weighbridge.sinks.writers import write_lines

    a = _audit(spark)
    out = os.path.join(tempfile.mkdtemp(prefix="wb-lines-"), "findings")
    write_lines(finding_lines(a.findings), out)
    back = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert sorted(x["code"] for x in back) == ["budget/too-long", "imports/unresolved"]


def test_laid_out_snapshot_prunes_and_agrees(spark):
    from pyspark.sql import functions as F

    from weighbridge.sinks.writers import write_snapshot
    from weighbridge.sources.readers import load_snapshot

    rows = [
        ("CLAUDE.md", "@docs/a.md\n@gone.md\n" + "x" * 40),
        ("docs/a.md", "@b.md\n" + "y" * 80),
        ("docs/b.md", "z" * 12),
        (".mcp.json", '{"mcpServers":{"m":{"toolsFile":"tools.json"}}}'),
        ("tools.json", '[{"name":"t"}]'),
        ("src/app.py", "print(1)  # token = f33e61083db5dbdf4bd2369d2f80176e57f7fda2"),
        ("node_modules/x/AGENTS.md", "hidden"),
    ]
    plain = files_df(spark, rows)
    out = os.path.join(tempfile.mkdtemp(prefix="wb-snapshot-"), "snap")
    write_snapshot(plain, out)
    laid = load_snapshot(spark, out)
    assert {r["path_class"] for r in laid.collect()} == {"context", "importable", "config", "other"}

    def summary(files):
        a = audit(files, weigher="bytes4")
        return (
            sorted(tuple(r) for r in a.budget_entries.select("repo_id", "label", "tokens").collect()),
            sorted(tuple(r) for r in a.findings.select("file", "code").collect()),
            sorted(tuple(r) for r in a.health.collect()),
        )

    assert summary(laid) == summary(plain)
    # the scans prune by directory, and the default audit keeps no copy of the snapshot
    assert "InMemoryRelation" not in audit(laid).edges._jdf.queryExecution().optimizedPlan().toString()
    from weighbridge.operators.classify import scan_context_files
    from weighbridge.operators.imports import extract_edges

    ctx_plan = scan_context_files(laid)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(path_class" in ctx_plan and "= context" in ctx_plan
    edge_plan = extract_edges(laid)._jdf.queryExecution().executedPlan().toString()
    assert "path_class#" in edge_plan and "IN (context,importable)" in edge_plan


def test_write_reports(spark):
    from weighbridge.sinks.writers import write_reports

    a = _audit(spark)
    paths = write_reports(a, tempfile.mkdtemp(prefix="wb-reports-"), "2026-07-02T00:00:00Z")
    summary = [json.loads(r["value"]) for r in spark.read.text(paths["summary"]).collect()]
    assert sorted(x["health"]["grade"] for x in summary) == ["A", "A", "N/A"]
    sarif = {repo: json.loads(text) for repo, text in _assembled(paths["sarif"]).items()}
    assert all(d["version"] == "2.1.0" for d in sarif.values()) and set(sarif) == {"r1", "r_none", "r_clean"}
    report = {repo: json.loads(text) for repo, text in _assembled(paths["report"]).items()}
    assert [e["label"] for e in report["r1"]["budget"]["entries"]] == ["CLAUDE.md", "AGENTS.md"]
    entries = [json.loads(r["value"]) for r in spark.read.text(paths["entries"]).collect()]
    assert {e["label"] for e in entries} == {"CLAUDE.md", "AGENTS.md"}
    assert {r["repo"] for r in read_scan_results(spark, paths["results"], multi_line=False).collect()} == {"r1", "r_none", "r_clean"}


def test_pending_scan_reads_each_text_once(spark, tmp_path):
    from weighbridge.sinks.results import ResultStore
    from weighbridge.streaming.incremental import scan_pending

    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(f"r{i}", name, text) for i in range(6) for name, text in (("CLAUDE.md", "@a.md\nx"), ("a.md", "body"), (".mcp.json", "{}"))]
    files = spark.createDataFrame(rows, "repo_id string, rel_path string, content string")
    files = files.withColumn("content", F.udf(seen, "string")("content"))
    manifest = spark.createDataFrame([(f"r{i}", 3) for i in range(6)], "repo_id string, n_files long")
    scan_pending(manifest, files, str(tmp_path / "out"), "2026-07-02T00:00:00.000Z", weigher="bytes4")
    got = {r["repo_id"]: (r["status"], r["always_on_tokens"]) for r in ResultStore(spark, str(tmp_path / "out")).results().collect()}
    assert got == {f"r{i}": ("ok", 3) for i in range(6)}
    assert read.value == len(rows)


def test_repository_names_of_fixtures(spark):
    from weighbridge.sources.fixtures import _repo_of

    ids = [0, 7, 999, 1000, 12345, 7_200_000, -5, None]
    df = spark.createDataFrame([(i,) for i in ids], "n long")
    assert [r[0] for r in df.select(_repo_of(F.col("n"))).collect()] == [
        "repo0000", "repo0007", "repo0999", "repo1000", "repo12345", "repo7200000", "repo-005", "reponull",
    ]
