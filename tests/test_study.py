from weighbridge.operators import study as S

# ---- fixed values: the published study table (owner/repo, grade, always-on, truncates) ----
STUDY_ROWS = [
    ("Kilo-Org/kilocode", "F", 31687, True), ("promptfoo/promptfoo", "D", 26497, False),
    ("simstudioai/sim", "F", 20994, False), ("langgenius/dify", "C", 17888, False),
    ("langchain-ai/deepagents", "B", 16006, False), ("CopilotKit/CopilotKit", "F", 15697, False),
    ("crewAIInc/crewAI", "D", 13700, True), ("browser-use/browser-use", "D", 11647, True),
    ("activepieces/activepieces", "F", 9915, False), ("mastra-ai/mastra", "D", 8987, False),
    ("mem0ai/mem0", "F", 7696, False), ("infiniflow/ragflow", "B", 6557, False),
    ("lobehub/lobehub", "F", 6149, False), ("agno-agi/agno", "B", 5683, False),
    ("openai/codex", "B", 5330, False), ("aaif-goose/goose", "A", 5266, False),
    ("charmbracelet/crush", "C", 4415, False), ("openai/openai-agents-python", "A", 3555, False),
    ("vercel/ai", "B", 3029, False), ("cline/cline", "A", 2531, False),
    ("QwenLM/qwen-code", "D", 2454, False), ("vercel-labs/agent-browser", "F", 2303, False),
    ("microsoft/autogen", "A", 2174, False), ("danny-avila/LibreChat", "A", 1989, False),
    ("browserbase/stagehand", "B", 1632, False), ("assafelovic/gpt-researcher", "A", 1126, False),
    ("continuedev/continue", "A", 1009, False), ("langchain-ai/langgraph", "A", 855, False),
    ("google/adk-python", "A", 324, False), ("oraios/serena", "A", 156, False),
    ("RooCodeInc/Roo-Code", "A", 95, False), ("anthropics/claude-code", "C", 0, False),
    ("SWE-agent/SWE-agent", "A", 0, False),
]
SCHEMA = (
    "repo_id string, owner string, repo string, status string, scanned_at string, grade string, "
    "always_on_tokens long, truncates boolean, has_email boolean, has_private_ip boolean, has_credential boolean"
)


def _results(spark, rows, extra=()):
    data = []
    for name, grade, tokens, trunc in rows:
        owner, repo = name.split("/")
        data.append((name, owner, repo, "ok", "2026-07-02T10:00:00Z", grade, tokens, trunc, False, False, False))
    data.extend(extra)
    return spark.createDataFrame(data, SCHEMA)


def test_published_study_figures(spark):
    extra = [(f"na{i}", "o", f"na{i}", "n/a", "2026-07-01T00:00:00Z", "N/A", 0, False, False, False, False) for i in range(4)]
    extra += [(f"err{i}", "o", f"err{i}", "error", "", None, None, False, False, False, False) for i in range(5)]
    r = _results(spark, STUDY_ROWS, extra)
    s = S.study_summary(r).collect()[0]
    assert (s["n_total"], s["n_ok"], s["n_na"], s["n_error"]) == (42, 33, 4, 5)
    assert (s["always_median"], s["always_min"], s["always_max"]) == (4415, 0, 31687)
    assert (s["n_over_low"], s["pct_over_low"], s["n_over_high"], s["pct_over_high"]) == (23, 70, 10, 30)
    assert (s["n_truncates"], s["pct_truncates"], s["scan_date"]) == (3, 9, "2026-07-02")
    hist = {x["grade"]: x["n_repos"] for x in S.study_grade_histogram(r).collect()}
    assert hist == {"A": 12, "B": 6, "C": 3, "D": 5, "F": 7}
    rank = [x["name"] for x in S.study_ranking(r).orderBy("rank").collect()]
    assert rank[:2] == ["Kilo-Org/kilocode", "promptfoo/promptfoo"]
    assert rank[-2:] == ["SWE-agent/SWE-agent", "anthropics/claude-code"]  # tie on 0 broken by name


def test_even_count_median_and_empty(spark):
    r = _results(spark, [("a/a", "A", 10, False), ("b/b", "A", 15, False), ("c/c", "B", 4, False), ("d/d", "C", 100, False)])
    assert S.study_summary(r).collect()[0]["always_median"] == 13  # (10 + 15) / 2 = 12.5, half up
    none = _results(spark, [], [("x", "o", "x", "n/a", "", "N/A", 0, False, False, False, False)])
    s = S.study_summary(none).collect()[0]
    assert (s["n_ok"], s["always_median"], s["always_min"], s["pct_over_low"]) == (0, 0, 0, 0)
    hist = {x["grade"]: x["n_repos"] for x in S.study_grade_histogram(none).collect()}
    assert hist == {"A": 0, "B": 0, "C": 0, "D": 0, "F": 0}


def test_reference_shaped_documents(spark):
    import json
    import os
    import tempfile

    from weighbridge.sources.readers import read_scan_results

    def doc(owner, repo, status, grade=None, always=0, findings=(), scanned="2026-07-02T09:00:00.000Z"):
        report = None
        if status != "error":
            report = {
                "health": {"grade": grade, "score": None, "noContext": status == "n/a",
                           "findings": [{"severity": s, "code": c} for s, c in findings]},
                "budget": {"alwaysOnTokens": always, "onDemandTokens": 0, "onDemandCount": 0},
            }
        return {"url": f"https://h/{owner}/{repo}", "owner": owner, "repo": repo, "status": status,
                "scannedAt": scanned, "commit": None, "error": None if report else "git clone failed", "report": report}

    docs = [
        doc("o", "a", "ok", "D", 11647, [("warn", "budget/over-truncation-limit"), ("warn", "secrets/email")]),
        doc("o", "b", "ok", "A", 900, [("info", "budget/over-truncation-limit")]),  # on-demand only: no truncation
        doc("o", "c", "ok", "F", 3000, [("error", "secrets/aws-key"), ("info", "secrets/placeholder")]),
        doc("o", "d", "n/a", "N/A", 0, scanned="2026-07-03T10:00:00.000Z"),
        doc("o", "e", "error", scanned=""),
    ]
    folder = tempfile.mkdtemp(prefix="wb-ref-results-")
    for d in docs:
        with open(os.path.join(folder, f"{d['owner']}__{d['repo']}.json"), "w") as fh:
            fh.write(json.dumps(d, indent=2) + "\n")
    flat = S.flatten_scan_results(read_scan_results(spark, folder))
    s = S.study_summary(flat).collect()[0]
    assert (s["n_total"], s["n_ok"], s["n_na"], s["n_error"]) == (5, 3, 1, 1)
    assert (s["always_median"], s["n_over_low"], s["n_over_high"], s["n_truncates"]) == (3000, 2, 1, 1)
    assert s["scan_date"] == "2026-07-03"
    p = S.study_prevalence(flat).collect()[0]
    assert (p["n_email"], p["n_private_ip"], p["n_credential"], p["pct_credential"]) == (1, 0, 1, 33)
