from pyspark.sql import functions as F

from tests.conftest import files_df
from weighbridge.operators.classify import classify_kind, classify_load, scan_context_files


def test_classify_kind_names(spark):
    names = [
        ("CLAUDE.md", "claude"), ("CLAUDE.local.md", "claude"), ("AGENTS.md", "agents"), ("GEMINI.md", "gemini"),
        (".cursorrules", "cursor"), (".windsurfrules", "windsurf"), ("copilot-instructions.md", "copilot"),
        ("CONTEXT_FOR_AI.md", "other"), ("SKILL.md", "skill"), ("x.mdc", "cursor"),
        ("claude.md", None), ("CLAUDE.md.bak", None), ("README.md", None),
    ]
    df = spark.createDataFrame([(n,) for n, _ in names], "name string")
    got = {r["name"]: r["kind"] for r in df.select("name", classify_kind(F.col("name")).alias("kind")).collect()}
    assert got == dict(names)


def test_classify_load(spark):
    df = spark.createDataFrame([("SKILL.md",), ("r.mdc",), ("AGENTS.md",)], "name string")
    got = {r[0]: r[1] for r in df.select("name", classify_load(F.col("name"))).collect()}
    assert got == {"SKILL.md": "ondemand", "r.mdc": "ondemand", "AGENTS.md": "always"}


def test_scan_depth_ignore_and_any_directory(spark):
    rows = [
        ("CLAUDE.md", "x"),
        ("a/copilot-instructions.md", "x"),
        ("a/b/c/d/e/f/AGENTS.md", "x"),  # 6 parent directories: kept
        ("a/b/c/d/e/f/g/AGENTS.md", "x"),  # 7: too deep
        ("node_modules/p/AGENTS.md", "x"),
        ("src/dist/CLAUDE.md", "x"),  # ignored at any level
        ("dist.md", "x"),  # file name is never tested against the ignore list
        ("x/build", "x"),
        ("notes/README.md", "x"),
    ]
    got = sorted(r["rel_path"] for r in scan_context_files(files_df(spark, rows)).collect())
    assert got == ["CLAUDE.md", "a/b/c/d/e/f/AGENTS.md", "a/copilot-instructions.md"]


def test_file_metrics(spark):
    rows = [
        ("e/CLAUDE.md", ""), ("a/CLAUDE.md", "a\n"), ("c/CLAUDE.md", "a\r\nb\r\n"),
        ("m/CLAUDE.md", "é€"), ("s/CLAUDE.md", "😀"),
    ]
    got = {r["rel_path"]: (r["bytes"], r["lines"]) for r in scan_context_files(files_df(spark, rows)).collect()}
    assert got == {
        "e/CLAUDE.md": (0, 1), "a/CLAUDE.md": (2, 2), "c/CLAUDE.md": (6, 3), "m/CLAUDE.md": (5, 1), "s/CLAUDE.md": (4, 1),
    }
