from tests.conftest import files_df
from weighbridge.operators.classify import scan_context_files
from weighbridge.operators.findings import size_findings


def _findings(spark, rows):
    ctx = scan_context_files(files_df(spark, rows))
    return {(r["file"], r["code"]): r for r in size_findings(ctx).collect()}


def test_line_boundaries(spark):
    rows = [("a/CLAUDE.md", "\n" * 199), ("b/CLAUDE.md", "\n" * 200), ("s/SKILL.md", "\n" * 200)]
    f = _findings(spark, rows)
    assert ("a/CLAUDE.md", "budget/too-long") not in f
    long_always = f[("b/CLAUDE.md", "budget/too-long")]
    assert long_always["severity"] == "warn"
    assert long_always["message"] == 'b/CLAUDE.md is 201 lines (recommended <= 200); tail may be ignored ("lost in the middle").'
    assert long_always["suggestion"].startswith("Trim b/CLAUDE.md to the essentials")
    od = f[("s/SKILL.md", "budget/too-long")]
    assert od["severity"] == "info" and od["suggestion"] is None
    assert od["message"].endswith(" — on-demand, so it only costs tokens when invoked, not every turn.")


def test_byte_boundaries_and_kib(spark):
    rows = [("a/AGENTS.md", "x" * 32768), ("b/AGENTS.md", "x" * 32769), ("c/AGENTS.md", "x" * 34048), ("r.mdc", "x" * 40000)]
    f = _findings(spark, rows)
    assert ("a/AGENTS.md", "budget/over-truncation-limit") not in f
    assert f[("b/AGENTS.md", "budget/over-truncation-limit")]["message"] == "b/AGENTS.md is 32.0 KiB; some agents truncate past 32 KiB."
    c = f[("c/AGENTS.md", "budget/over-truncation-limit")]  # 33.25 KiB, half up
    assert "33.3 KiB" in c["message"] and c["suggestion"].startswith("Split c/AGENTS.md (33.3 KiB):")
    od = f[("r.mdc", "budget/over-truncation-limit")]
    assert od["severity"] == "info" and od["suggestion"].startswith("Split r.mdc (39.1 KiB)")
