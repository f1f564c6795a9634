"""Token budget: entries per source, per-repository totals, rank, share,
top on-demand entries with a remainder row, and the always-on cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weighbridge import dims
from weighbridge.functions.paths import path_order
from weighbridge.plans.ranking import rank_within

ENTRY_COLUMNS = [
    "repo_id",
    "label",
    "tokens",
    "load",
    "note",
    "own_tokens",
    "imported_tokens",
    "n_imports",
    "src_ord",
    "file_path",
    "server_ord",
]


def budget_entries(context_tokens: DataFrame, imported: DataFrame, mcp: DataFrame) -> DataFrame:
    """One entry per context file (own + imported tokens) and one always-on entry per tool server.

    ``own_tokens``, ``imported_tokens`` and ``n_imports`` are set only when the
    file folds in a non-zero import cost.
    """
    imp = imported.select(
        "repo_id", F.col("importer_path").alias("rel_path"), "imported_tokens", "n_imports"
    )
    f = context_tokens.select("repo_id", "rel_path", "load", F.col("tokens").alias("own")).join(
        imp, ["repo_id", "rel_path"], "left"
    )
    has_imp = F.coalesce(F.col("imported_tokens"), F.lit(0)) > 0
    files_e = f.select(
        "repo_id",
        F.col("rel_path").alias("label"),
        (F.col("own") + F.coalesce(F.col("imported_tokens"), F.lit(0))).cast("long").alias("tokens"),
        "load",
        F.lit(None).cast("string").alias("note"),
        F.when(has_imp, F.col("own")).cast("long").alias("own_tokens"),
        F.when(has_imp, F.col("imported_tokens")).cast("long").alias("imported_tokens"),
        F.when(has_imp, F.col("n_imports")).cast("long").alias("n_imports"),
        F.lit(0).alias("src_ord"),
        F.col("rel_path").alias("file_path"),
        F.lit(None).cast("int").alias("server_ord"),
    )
    mcp_e = mcp.select(
        "repo_id",
        F.concat(F.lit("mcp:"), F.col("server"), F.lit(" (schemas)")).alias("label"),
        F.col("tokens").cast("long").alias("tokens"),
        F.lit("always").alias("load"),
        "note",
        F.lit(None).cast("long").alias("own_tokens"),
        F.lit(None).cast("long").alias("imported_tokens"),
        F.lit(None).cast("long").alias("n_imports"),
        F.lit(1).alias("src_ord"),
        F.lit(None).cast("string").alias("file_path"),
        F.col("ord").cast("int").alias("server_ord"),
    )
    return files_e.unionByName(mcp_e).select(*ENTRY_COLUMNS)


def _weight_order(collation: str) -> list:
    """Heaviest first, ties in input order: files in path order, then tool servers."""
    path = F.col("file_path")
    paths = [path] if collation == "UTF8_BINARY" else [path_order(path, collation), path]
    return [F.desc("tokens"), F.col("src_ord"), *paths, F.col("server_ord")]


def budget_rank(entries: DataFrame, collation: str = "UTF8_BINARY") -> DataFrame:
    """Entries with ``rank``: always-on first, heaviest first, ties in input order (skew-safe)."""
    load_ord = F.when(F.col("load") == "always", F.lit(0)).otherwise(F.lit(1))
    return rank_within(entries, ["repo_id"], [load_ord, *_weight_order(collation)], out="rank")


def budget_totals(
    repos: DataFrame,
    entries: DataFrame,
    model: str | None = None,
    window: int = dims.DEFAULT_CONTEXT_WINDOW,
) -> DataFrame:
    """``repo_id, always_on_tokens, on_demand_tokens, on_demand_count, context_window, window_pct, est_cost_usd``.

    Unknown or absent model → null cost. Repositories with no entries get zeros.
    """
    always = F.col("load") == "always"
    per = entries.groupBy("repo_id").agg(
        F.sum(F.when(always, F.col("tokens")).otherwise(F.lit(0))).alias("always_on_tokens"),
        F.sum(F.when(~always, F.col("tokens")).otherwise(F.lit(0))).alias("on_demand_tokens"),
        F.count_if(~always).alias("on_demand_count"),
    )
    out = repos.select("repo_id").join(per, "repo_id", "left")
    rate = dims.PRICING_USD_PER_MTOK.get(model) if model else None
    a = F.coalesce(F.col("always_on_tokens"), F.lit(0)).cast("long")
    return out.select(
        "repo_id",
        a.alias("always_on_tokens"),
        F.coalesce(F.col("on_demand_tokens"), F.lit(0)).cast("long").alias("on_demand_tokens"),
        F.coalesce(F.col("on_demand_count"), F.lit(0)).cast("long").alias("on_demand_count"),
        F.lit(window).cast("long").alias("context_window"),
        F.round(a / F.lit(float(window)) * 100.0, 1).alias("window_pct"),
        (a / F.lit(1_000_000.0) * F.lit(rate) if rate is not None else F.lit(None)).cast("double").alias("est_cost_usd"),
    )


def budget_share(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries with ``share_pct`` = round(tokens / (always + on-demand, or 1) × 100), half up."""
    grand = totals.select(
        "repo_id", (F.col("always_on_tokens") + F.col("on_demand_tokens")).alias("_grand")
    )
    g = F.when(F.col("_grand") == 0, F.lit(1)).otherwise(F.col("_grand"))
    return entries.join(grand, "repo_id").withColumn(
        "share_pct", F.floor(F.col("tokens") * 100.0 / g + 0.5).cast("long")
    ).drop("_grand")


def budget_top_on_demand(entries: DataFrame, k: int = dims.ON_DEMAND_TOP, collation: str = "UTF8_BINARY") -> DataFrame:
    """Every always-on entry, the ``k`` heaviest on-demand ones, and one remainder row
    (``label = "more"``, count and token sum of the rest) where any are left.

    The top-k is a group-limited window (cut map-side before the shuffle); the
    remainder is totals minus the kept rows, both plain partial aggregates.
    """
    ondemand = entries.where(F.col("load") == "ondemand")
    w = W.partitionBy("repo_id").orderBy(*_weight_order(collation))
    top = ondemand.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    always = entries.where(F.col("load") == "always").withColumn("pos", F.lit(None).cast("int"))
    kept = always.unionByName(top).select(
        "repo_id", "label", "tokens", "load", F.col("pos").cast("int").alias("pos"), F.lit(1).cast("long").alias("n_entries")
    )
    all_od = ondemand.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    top_od = top.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_top"), F.sum("tokens").alias("t_top"))
    rest = all_od.join(top_od, "repo_id").where(F.col("n") > F.col("n_top")).select(
        "repo_id",
        F.lit("more").alias("label"),
        (F.col("t") - F.col("t_top")).cast("long").alias("tokens"),
        F.lit("ondemand").alias("load"),
        F.lit(k + 1).cast("int").alias("pos"),
        (F.col("n") - F.col("n_top")).cast("long").alias("n_entries"),
    )
    return kept.unionByName(rest)
