"""Corpus study: per-repository results and the statistics over them.

Every statistic is a one-pass conditional aggregate (partial aggregation per
map task), except the exact median and the ranking, which use the skew-safe
distributed sort in :mod:`weighbridge.plans.ranking`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.urls import owner_repo
from weighbridge.plans.ranking import exact_median_half_up, rank_within
from weighbridge.session import materialize


def scan_results(a, scanned_at: str, urls: DataFrame | None = None) -> DataFrame:
    """One flat row per listed repository: status, grade, budget totals and finding flags.

    status: ``error`` when a context file of the repository is unreadable, else ``n/a`` without context files, else ``ok``.
    """
    f = a.findings
    flags = f.groupBy("repo_id").agg(
        F.bool_or((F.col("code") == dims.CODE_OVER_TRUNCATION) & (F.col("severity") == "warn")).alias("truncates"),
        F.bool_or(F.col("code") == "secrets/email").alias("has_email"),
        F.bool_or(F.col("code") == "secrets/private-ip").alias("has_private_ip"),
        F.bool_or(F.col("code").isin(dims.CREDENTIAL_CODES)).alias("has_credential"),
    )
    unreadable = a.context_errors.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_unreadable"))
    r = (
        a.health.join(a.budget.select("repo_id", "always_on_tokens", "on_demand_tokens", "on_demand_count"), "repo_id", "left")
        .join(flags, "repo_id", "left")
        .join(unreadable, "repo_id", "left")
    )
    if urls is not None:
        r = r.join(urls.select("repo_id", "url", *[c for c in urls.columns if c == "commit"]), "repo_id", "left")
    else:
        r = r.withColumn("url", F.col("repo_id"))
    owner, repo = owner_repo(F.coalesce(F.col("url"), F.col("repo_id")))
    err = F.col("n_unreadable").isNotNull()
    status = F.when(err, F.lit("error")).when(F.col("no_context"), F.lit("n/a")).otherwise(F.lit("ok"))
    return r.select(
        "repo_id",
        "url",
        owner.alias("owner"),
        repo.alias("repo"),
        status.alias("status"),
        F.lit(scanned_at).alias("scanned_at"),
        (F.col("commit") if "commit" in r.columns else F.lit(None)).cast("string").alias("commit"),
        F.when(err, F.format_string("%d unreadable file(s)", F.col("n_unreadable"))).alias("error"),
        "grade",
        "score",
        "no_context",
        "always_on_tokens",
        "on_demand_tokens",
        "on_demand_count",
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("truncates", "has_email", "has_private_ip", "has_credential")],
    )


def flatten_scan_results(docs: DataFrame) -> DataFrame:
    """Reference-shaped result documents (nested report) → the flat study shape."""
    fnd = F.coalesce(F.col("report.health.findings"), F.array())
    has = lambda pred: F.exists(fnd, pred)
    ok_report = F.col("report").isNotNull()
    return docs.select(
        F.col("url"),
        F.col("url").alias("repo_id"),
        "owner",
        "repo",
        F.when((F.col("status") == "ok") & ~ok_report, F.lit("ok-no-report")).otherwise(F.col("status")).alias("status"),
        F.col("scannedAt").alias("scanned_at"),
        "error",
        F.col("report.health.grade").alias("grade"),
        F.col("report.health.score").cast("int").alias("score"),
        F.col("report.health.noContext").alias("no_context"),
        F.col("report.budget.alwaysOnTokens").alias("always_on_tokens"),
        F.col("report.budget.onDemandTokens").alias("on_demand_tokens"),
        F.col("report.budget.onDemandCount").alias("on_demand_count"),
        has(lambda x: (x["code"] == dims.CODE_OVER_TRUNCATION) & (x["severity"] == "warn")).alias("truncates"),
        has(lambda x: x["code"] == "secrets/email").alias("has_email"),
        has(lambda x: x["code"] == "secrets/private-ip").alias("has_private_ip"),
        has(lambda x: x["code"].isin(dims.CREDENTIAL_CODES)).alias("has_credential"),
    )


def _pct(n, d):
    """Rounded percent, half up; 0 when the denominator is 0 (ANSI-safe)."""
    return F.when(d == 0, F.lit(0)).otherwise(F.floor(n * 100.0 / F.when(d == 0, F.lit(1)).otherwise(d) + 0.5)).cast("long")


def _ok(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "ok")


def study_summary(results: DataFrame, over_low: int = 2000, over_high: int = 8000) -> DataFrame:
    """One row: coverage counts, always-on median/min/max, threshold and truncation shares, scan date."""
    # read by the counts and by the median: the repositories' rows are made once
    results = materialize(results.select("status", "always_on_tokens", "truncates", "scanned_at"), "study")
    ok = F.col("status") == "ok"
    a = F.col("always_on_tokens")
    date = F.max(F.when(F.col("scanned_at") != "", F.col("scanned_at")))
    counts = results.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col("status") == "n/a").alias("n_na"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.coalesce(F.min(F.when(ok, a)), F.lit(0)).alias("always_min"),
        F.coalesce(F.max(F.when(ok, a)), F.lit(0)).alias("always_max"),
        F.count_if(ok & (a > over_low)).alias("n_over_low"),
        F.count_if(ok & (a > over_high)).alias("n_over_high"),
        F.count_if(ok & F.col("truncates")).alias("n_truncates"),
        F.coalesce(F.substring(date, 1, 10), F.lit("unknown")).alias("scan_date"),
    )
    median = exact_median_half_up(_ok(results), "always_on_tokens", "m").scalar()
    n_ok = F.col("n_ok")
    return counts.select(
        *[F.col(c).cast("long").alias(c) for c in ("n_total", "n_ok", "n_na", "n_error")],
        median.alias("always_median"),
        F.col("always_min").cast("long").alias("always_min"),
        F.col("always_max").cast("long").alias("always_max"),
        F.col("n_over_low").cast("long").alias("n_over_low"),
        _pct(F.col("n_over_low"), n_ok).alias("pct_over_low"),
        F.col("n_over_high").cast("long").alias("n_over_high"),
        _pct(F.col("n_over_high"), n_ok).alias("pct_over_high"),
        F.col("n_truncates").cast("long").alias("n_truncates"),
        _pct(F.col("n_truncates"), n_ok).alias("pct_truncates"),
        "scan_date",
    )


def study_grade_histogram(results: DataFrame) -> DataFrame:
    """Repositories per grade A..F among the ``ok`` ones, zeros shown, fixed order."""
    grades = dims.grade_dim(results.sparkSession)
    counts = _ok(results).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    return grades.join(counts, "grade", "left").select(
        "grade", "grade_ord", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_repos")
    )


def study_prevalence(results: DataFrame) -> DataFrame:
    """Repositories (not findings) with an e-mail, a private IP, a credential-shaped code."""
    ok = results.where(F.col("status") == "ok")
    counts = ok.agg(
        F.count(F.lit(1)).alias("n_ok"),
        F.count_if(F.col("has_email")).alias("n_email"),
        F.count_if(F.col("has_private_ip")).alias("n_private_ip"),
        F.count_if(F.col("has_credential")).alias("n_credential"),
    )
    n = F.col("n_ok")
    return counts.select(
        n.cast("long").alias("n_ok"),
        F.col("n_email").cast("long").alias("n_email"),
        _pct(F.col("n_email"), n).alias("pct_email"),
        F.col("n_private_ip").cast("long").alias("n_private_ip"),
        _pct(F.col("n_private_ip"), n).alias("pct_private_ip"),
        F.col("n_credential").cast("long").alias("n_credential"),
        _pct(F.col("n_credential"), n).alias("pct_credential"),
    )


def study_ranking(results: DataFrame) -> DataFrame:
    """``ok`` repositories by always-on tokens descending (then owner/repo): rank, grade, tokens, truncates."""
    ok = _ok(results).select(
        F.concat_ws("/", "owner", "repo").alias("name"),
        "repo_id",
        "grade",
        F.col("always_on_tokens").cast("long").alias("always_on_tokens"),
        F.when(F.col("truncates"), F.lit("yes")).otherwise(F.lit("no")).alias("truncates"),
    )
    ranked = rank_within(ok, [], [F.desc("always_on_tokens"), F.col("name"), F.col("repo_id")], out="rank")
    return ranked.select("rank", "name", "repo_id", "grade", "always_on_tokens", "truncates")
