"""Findings: size rules, broken imports, secrets; one union with an order.

Every finding carries ``(file, rule_ord, item_ord)``: files in path order, then
too-long, over-truncation, secrets, unresolved, then the rule's own order.
``item_ord`` is a list of numbers compared in turn, never packed or dense, so no
count can run over and no window is needed to make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.paths import path_order
from weighbridge.functions.text import kib

FINDING_COLUMNS = [
    "repo_id",
    "file",
    "line",
    "rule_ord",
    "item_ord",
    "severity",
    "sev_rank",
    "code",
    "message",
    "suggestion",
]


def sev_rank(severity: Column) -> Column:
    r = None
    for name, rank in dims.SEVERITY_RANK.items():
        r = F.when(severity == name, F.lit(rank)) if r is None else r.when(severity == name, F.lit(rank))
    return r


def sev_penalty(severity: Column) -> Column:
    r = None
    for name, pts in dims.SEVERITY_PENALTY.items():
        r = F.when(severity == name, F.lit(pts)) if r is None else r.when(severity == name, F.lit(pts))
    return r


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("sev_rank", sev_rank(F.col("severity"))).select(*FINDING_COLUMNS)


def size_findings(context: DataFrame, max_lines: int = dims.MAX_LINES, max_bytes: int = dims.MAX_BYTES) -> DataFrame:
    """``budget/too-long`` (lines > max) and ``budget/over-truncation-limit`` (bytes > max).

    warn for always-on files, info for on-demand ones (with a hint in the text).
    """
    always = F.col("load") == "always"
    severity = F.when(always, F.lit("warn")).otherwise(F.lit("info"))
    hint = F.when(always, F.lit("")).otherwise(F.lit(dims.ON_DEMAND_HINT))
    rel = F.col("rel_path")
    limit_kib = f"{max_bytes / 1024:g}"
    too_long = context.where(F.col("lines") > max_lines).select(
        "repo_id",
        rel.alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(1).alias("rule_ord"),
        F.array(F.lit(0).cast("long")).alias("item_ord"),
        severity.alias("severity"),
        F.lit(dims.CODE_TOO_LONG).alias("code"),
        F.format_string(dims.MESSAGE_TOO_LONG.format(limit=max_lines), rel, F.col("lines"), hint).alias("message"),
        F.when(always, F.format_string(dims.SUGGEST_TOO_LONG, rel)).alias("suggestion"),
    )
    size = kib(F.col("bytes"))
    over = context.where(F.col("bytes") > max_bytes).select(
        "repo_id",
        rel.alias("file"),
        F.lit(None).cast("int").alias("line"),
        F.lit(2).alias("rule_ord"),
        F.array(F.lit(0).cast("long")).alias("item_ord"),
        severity.alias("severity"),
        F.lit(dims.CODE_OVER_TRUNCATION).alias("code"),
        F.format_string(dims.MESSAGE_OVER_TRUNCATION.format(limit=limit_kib), rel, size, hint).alias("message"),
        F.format_string(dims.SUGGEST_OVER_TRUNCATION.format(limit=limit_kib), rel, size).alias("suggestion"),
    )
    return _finish(too_long.unionByName(over))


def unresolved_findings(unresolved: DataFrame) -> DataFrame:
    """One info finding per distinct broken spec per start file (``imports/unresolved``), in import-tree order."""
    return _finish(
        unresolved.select(
            "repo_id",
            F.col("root_path").alias("file"),
            F.lit(None).cast("int").alias("line"),
            F.lit(4).alias("rule_ord"),
            F.col("place").cast("array<bigint>").alias("item_ord"),
            F.lit("info").alias("severity"),
            F.lit(dims.CODE_UNRESOLVED).alias("code"),
            F.format_string(dims.MESSAGE_UNRESOLVED, F.col("root_path"), F.col("spec")).alias("message"),
            F.lit(dims.SUGGEST_UNRESOLVED).alias("suggestion"),
        )
    )


def finding_location(file: Column, line: Column) -> Column:
    """``file:line`` when there is a line, else the file, else empty."""
    return F.when(file.isNotNull() & (line > 0), F.concat(file, F.lit(":"), line.cast("string"))).otherwise(
        F.coalesce(file, F.lit(""))
    )


def finding_place(collation: str = "UTF8_BINARY") -> list[Column]:
    """The columns that order findings: files in path order, then each file's rules and items."""
    order = [] if collation == "UTF8_BINARY" else [path_order(F.col("file"), collation).alias("file_order")]
    return [*order, F.col("file"), F.col("rule_ord"), F.col("item_ord")]


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
