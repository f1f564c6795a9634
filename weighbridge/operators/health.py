"""Health per repository: score, grade, N/A rows; the CI gate; summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge import dims
from weighbridge.operators.findings import finding_place, sev_penalty


def grade_for(score: Column) -> Column:
    g = None
    for grade, floor in dims.GRADE_FLOORS:
        g = F.when(score >= floor, F.lit(grade)) if g is None else g.when(score >= floor, F.lit(grade))
    return g.otherwise(F.lit("F"))


def health(repos: DataFrame, context: DataFrame, findings: DataFrame) -> DataFrame:
    """``repo_id, n_files, n_findings, score, grade, no_context``: one row per listed repository.

    Both inputs are reduced to one row per repository by partial (map-side)
    aggregation before any shuffle, so a repository holding a third of all
    files costs no more than the others after the first stage.
    """
    files_per = context.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    found_per = findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum(sev_penalty(F.col("severity"))).alias("penalty")
    )
    h = repos.select("repo_id").join(files_per, "repo_id", "left").join(found_per, "repo_id", "left")
    no_context = F.col("n_files").isNull()
    score = F.when(no_context, F.lit(None)).otherwise(F.greatest(F.lit(0), 100 - F.coalesce(F.col("penalty"), F.lit(0))))
    return h.select(
        "repo_id",
        F.coalesce(F.col("n_files"), F.lit(0)).cast("long").alias("n_files"),
        F.when(no_context, F.lit(0)).otherwise(F.coalesce(F.col("n_findings"), F.lit(0))).cast("long").alias("n_findings"),
        score.cast("int").alias("score"),
        F.when(no_context, F.lit("N/A")).otherwise(grade_for(score)).alias("grade"),
        no_context.alias("no_context"),
    )


def parse_fail_on(spec: str) -> tuple[int | None, list[str]]:
    """``"error,secrets/aws-key"`` → (lowest severity rank asked, exact codes). Driver-side, tiny."""
    items = [t.strip() for t in spec.split(",") if t.strip()]
    ranks = [dims.SEVERITY_RANK[t] for t in items if t in dims.SEVERITY_RANK]
    codes = [t for t in items if t not in dims.SEVERITY_RANK]
    return (min(ranks) if ranks else None), codes


def fail_on_gate(repos: DataFrame, findings: DataFrame, spec: str) -> DataFrame:
    """``repo_id, matched, sev_matches, code_matches, tripped`` for a ``--fail-on`` list."""
    min_rank, codes = parse_fail_on(spec)
    sev_hit = (F.col("sev_rank") >= min_rank) if min_rank is not None else F.lit(False)
    code_hit = F.col("code").isin(codes) if codes else F.lit(False)
    per = findings.groupBy("repo_id").agg(
        F.count_if(sev_hit | code_hit).alias("matched"),
        F.count_if(sev_hit).alias("sev_matches"),
        F.count_if(code_hit).alias("code_matches"),
    )
    out = repos.select("repo_id").join(per, "repo_id", "left")
    cols = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("matched", "sev_matches", "code_matches")]
    return out.select("repo_id", *cols).withColumn("tripped", F.col("matched") > 0)


def problem_summary(findings: DataFrame, collation: str = "UTF8_BINARY") -> DataFrame:
    """Counts per problem code (placeholder left out) with worst severity and the summary text."""
    codes = list(dims.PROBLEM_LABELS)
    per = (
        findings.where(F.col("code").isin(codes))
        .groupBy("repo_id", "code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("sev_rank").alias("worst_rank"),
            F.min(F.struct(*finding_place(collation))).alias("first"),
        )
    )
    label = None
    for code, (one, many) in dims.PROBLEM_LABELS.items():
        text = F.concat(F.col("n").cast("string"), F.lit(" "), F.when(F.col("n") == 1, F.lit(one)).otherwise(F.lit(many)))
        label = F.when(F.col("code") == code, text) if label is None else label.when(F.col("code") == code, text)
    order = W.partitionBy("repo_id").orderBy(F.desc("worst_rank"), F.desc("n"), F.col("first"))
    return per.select(
        "repo_id",
        "code",
        F.col("n").cast("long").alias("n"),
        F.col("worst_rank").cast("int").alias("worst_rank"),
        label.alias("label"),
        F.row_number().over(order).cast("int").alias("pos"),
    )


def finding_groups(findings: DataFrame, collation: str = "UTF8_BINARY") -> DataFrame:
    """All codes with count, worst severity and first-seen order (members stay in ``findings``)."""
    per = findings.groupBy("repo_id", "code").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("sev_rank").alias("worst_rank"),
        F.min(F.struct(*finding_place(collation))).alias("first"),
    )
    order = W.partitionBy("repo_id").orderBy(F.desc("worst_rank"), F.desc("n"), F.col("first"))
    return per.select(
        "repo_id",
        "code",
        F.col("n").cast("long").alias("n"),
        F.col("worst_rank").cast("int").alias("worst_rank"),
        F.col("first.file").alias("first_file"),
        F.row_number().over(order).cast("int").alias("pos"),
    )


def top_suggestions(findings: DataFrame, k: int = dims.TOP_SUGGESTIONS, collation: str = "UTF8_BINARY") -> DataFrame:
    """Distinct suggestions, most severe first (stable), first ``k`` per repository, plus how many more.

    The top-k window is cut map-side (a partial group limit runs before the
    shuffle), so a hot repository sends at most ``k`` rows per map task.
    """
    per_text = (
        findings.where(F.col("suggestion").isNotNull())
        .groupBy("repo_id", "suggestion")
        .agg(F.min(F.struct((-F.col("sev_rank")).alias("neg_rank"), *finding_place(collation))).alias("key"))
    )
    n_distinct = per_text.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    order = W.partitionBy("repo_id").orderBy("key")
    top = per_text.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    return top.join(n_distinct, "repo_id").select(
        "repo_id",
        F.col("pos").cast("int").alias("pos"),
        "suggestion",
        F.greatest(F.col("n_distinct") - k, F.lit(0)).cast("long").alias("n_more"),
    )


def distinct_first_seen(findings: DataFrame, collation: str = "UTF8_BINARY") -> DataFrame:
    """Distinct non-null suggestions per repository in first-seen order (the report's fix list).

    ``first`` is the finding order key of the first occurrence; ``pos`` numbers
    the suggestions with the skew-safe rank (a repository's list is not
    gathered in one task).
    """
    from weighbridge.plans.ranking import rank_within

    firsts = (
        findings.where(F.col("suggestion").isNotNull())
        .groupBy("repo_id", "suggestion")
        .agg(F.min(F.struct(*finding_place(collation))).alias("first"))
    )
    ranked = rank_within(firsts, ["repo_id"], [F.col("first"), F.col("suggestion")], out="pos")
    return ranked.select("repo_id", "suggestion", F.col("first.file").alias("first_file"), "pos")
