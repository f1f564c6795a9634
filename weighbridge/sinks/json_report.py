"""JSON reports.

``report_documents``: one summary document per repository (health and budget
totals, no unbounded arrays). ``finding_lines`` / entry lines: one JSON line
per finding or budget entry, so a repository with millions of findings is
never gathered into one record. ``scan_result_documents``: the per-repository
result record of a corpus study; its findings are the distinct
``(severity, code)`` pairs (at most one per code and severity), which is all
the study statistics read. Counts stand under ``n...`` names, never under the names of
lists; null values are written as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.paths import path_order
from weighbridge.operators.findings import finding_place
from weighbridge.plans.ranking import rank_within
from weighbridge.sinks.documents import document_lines, listed, once, repository, separated

KEEP_NULLS = {"ignoreNullFields": "false"}


def report_documents(a) -> DataFrame:
    h, b = a.health, a.budget
    j = h.join(b, "repo_id", "left")
    health = F.struct(
        F.col("grade").alias("grade"), F.col("score").alias("score"), F.col("no_context").alias("noContext"),
        F.col("n_files").alias("nFiles"), F.col("n_findings").alias("nFindings"),
    )
    budget = F.struct(
        F.col("always_on_tokens").alias("alwaysOnTokens"), F.col("on_demand_tokens").alias("onDemandTokens"),
        F.col("on_demand_count").alias("onDemandCount"), F.col("context_window").alias("contextWindow"),
        F.col("est_cost_usd").alias("estCostUsd"),
    )
    return j.select("repo_id", F.to_json(F.struct(health.alias("health"), budget.alias("budget")), KEEP_NULLS).alias("json"))


def finding_lines(findings: DataFrame) -> DataFrame:
    rec = F.struct("severity", "code", "message", "suggestion", "file", F.when(F.col("line") > 0, F.col("line")).alias("line"))
    return findings.select("repo_id", "file", "rule_ord", "item_ord", F.to_json(rec, KEEP_NULLS).alias("json"))


def entry_lines(entries: DataFrame) -> DataFrame:
    rec = F.struct(
        "label", "tokens", "load", "note", F.col("own_tokens").alias("ownTokens"),
        F.col("imported_tokens").alias("importedTokens"), F.col("n_imports").alias("nImports"),
    )
    return entries.select("repo_id", F.to_json(rec, KEEP_NULLS).alias("json"))


def import_lines(claims: DataFrame) -> DataFrame:
    """One line per file an entry pays for: an entry's list of imported files, as rows."""
    rec = F.struct(F.col("importer_path").alias("label"), F.col("imported_path").alias("imports"))
    return claims.select("repo_id", F.to_json(rec).alias("json"))


def report_lines(a) -> DataFrame:
    """``repo_id, section, p, q, line``: one payload ``{repository, health, budget}`` per repository, as ordered lines
    (:mod:`weighbridge.sinks.documents`): files and findings beside the score, and entries, heaviest first, beside the
    totals. An entry that folds in files is a line that opens it, a line for each of them in path order, and one that closes it."""
    collation = a.path_collation
    path = F.col("rel_path")
    in_order = lambda c: [c] if collation == "UTF8_BINARY" else [path_order(c, collation), c]
    open_ended = lambda struct, name: F.concat(F.expr(f"left({struct}, length({struct}) - 1)"), F.lit(f',"{name}":['))
    score = a.health.select("repo_id", F.to_json(F.struct("grade", "score", F.col("no_context").alias("noContext")), KEEP_NULLS).alias("j"))
    opening = once(score, F.concat(F.lit("{"), repository(), F.lit(',"health":'), open_ended("j", "files")))
    file = F.struct(path.alias("relPath"), "kind", "load", "bytes", "lines")
    files = listed(a.context_rows.select("repo_id", "rel_path", "kind", "load", "bytes", "lines"), F.to_json(file), in_order(path))
    found = F.to_json(F.struct("severity", "code", "message", "suggestion", "file", F.when(F.col("line") > 0, F.col("line")).alias("line")))
    findings = listed(a.findings, found, [*finding_place(collation), F.col("code"), F.col("message")])
    totals = a.budget.select(
        "repo_id",
        F.to_json(
            F.struct(
                F.col("always_on_tokens").alias("alwaysOnTokens"), F.col("on_demand_tokens").alias("onDemandTokens"),
                F.col("on_demand_count").alias("onDemandCount"), F.col("context_window").alias("contextWindow"), F.col("est_cost_usd").alias("estCostUsd"),
            ),
            KEEP_NULLS,
        ).alias("j"),
    )
    middle = once(totals, F.concat(F.lit(']},"budget":'), open_ended("j", "entries")))
    ranked = a.budget_ranked
    entry = F.to_json(F.struct("label", "tokens", "load", "note", F.col("own_tokens").alias("ownTokens"), F.col("imported_tokens").alias("importedTokens")))
    ranked = ranked.select("repo_id", F.col("rank").alias("p"), "file_path", "n_imports", entry.alias("j"))
    folds = F.col("n_imports").isNotNull()
    heads = ranked.select("repo_id", "p", F.lit(0).cast("long").alias("q"), separated(F.col("p"), F.when(folds, open_ended("j", "imports")).otherwise(F.col("j"))).alias("line"))
    within = rank_within(a.claims, ["repo_id", "importer_path"], in_order(F.col("imported_path")), out="q")
    name = F.to_json(F.array("imported_path"))
    within = within.select("repo_id", F.col("importer_path").alias("file_path"), "q", separated(F.col("q"), F.substring(name, 2, F.length(name) - 2)).alias("line"))
    folded = ranked.where(folds)
    imports = within.join(folded.select("repo_id", "file_path", "p"), ["repo_id", "file_path"]).select("repo_id", "p", "q", "line")
    ends = folded.select("repo_id", "p", (F.col("n_imports") + 1).alias("q"), F.lit("]}").alias("line"))
    entries = heads.unionByName(imports).unionByName(ends)
    health_mid = once(score, F.lit('],"findings":['))
    return document_lines(opening, files, health_mid, findings, middle, entries, once(score, F.lit("]}}")))


def scan_result_documents(results: DataFrame, findings: DataFrame) -> DataFrame:
    """Nested study records (the shape ``read_scan_results`` reads), one per repository."""
    pairs = findings.select("repo_id", "severity", "code").distinct().groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("severity", "code"))).alias("pairs")
    )
    r = results.join(pairs, "repo_id", "left")
    report = F.when(
        F.col("status") != "error",
        F.struct(
            F.struct(
                F.col("grade").alias("grade"), F.col("score").cast("long").alias("score"), F.col("no_context").alias("noContext"),
                F.coalesce(F.col("pairs"), F.array().cast("array<struct<severity:string,code:string>>")).alias("findings"),
            ).alias("health"),
            F.struct(
                F.col("always_on_tokens").alias("alwaysOnTokens"), F.col("on_demand_tokens").alias("onDemandTokens"),
                F.col("on_demand_count").alias("onDemandCount"),
            ).alias("budget"),
        ),
    )
    return r.select(
        "url", "owner", "repo", "status", F.col("scanned_at").alias("scannedAt"), (F.col("commit") if "commit" in r.columns else F.lit(None)).cast("string").alias("commit"),
        "error", report.alias("report"),
    )
