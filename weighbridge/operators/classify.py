"""scan_context_files, classify_kind, classify_load, file_metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge import dims
from weighbridge.functions.text import basename, line_count


def classify_kind(name: Column) -> Column:
    """Basename → kind (exact, case-sensitive), then SKILL.md, then ``*.mdc``; else null.

    One literal-map lookup, so ``name`` is evaluated a constant number of times
    however many exact names there are.
    """
    exact = F.create_map(*[F.lit(x) for pair in dims.EXACT_KINDS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(exact, name),
        F.when(name == dims.SKILL_NAME, F.lit("skill")),
        F.when(name.endswith(dims.RULE_SUFFIX), F.lit("cursor")),
    )


def classify_load(name: Column) -> Column:
    return F.when((name == dims.SKILL_NAME) | name.endswith(dims.RULE_SUFFIX), F.lit("ondemand")).otherwise(
        F.lit("always")
    )


def discoverable(rel_path: Column, max_depth: int = dims.MAX_DEPTH) -> Column:
    """At most ``max_depth`` parent directories, none of them an ignored name."""
    parts = F.split(rel_path, "/")
    n_dirs = F.size(parts) - 1
    dirs = F.slice(parts, F.lit(1), n_dirs)
    ignored = F.array(*[F.lit(d) for d in dims.IGNORE_DIRS])
    return (n_dirs <= max_depth) & ~F.arrays_overlap(dirs, ignored)


def scan_context_files(files: DataFrame, max_depth: int = dims.MAX_DEPTH) -> DataFrame:
    """Context files of a snapshot, with kind, load, bytes and lines.

    Only path predicates decide membership, so they run before the content
    column is touched; the result is one row per discovered context file.
    Rows that hold ``bytes`` and ``lines`` instead of a text keep them.
    """
    name = basename(F.col("rel_path"))
    measured = ["bytes", "lines"]
    if "content" in files.columns:
        measured = [F.octet_length("content").cast("long").alias("bytes"), line_count(F.col("content")).alias("lines"), "content"]
    if "path_class" in files.columns:  # partition pruning on a laid-out snapshot
        files = files.where(F.col("path_class") == "context")
    return (
        files.withColumn("_name", name)
        .withColumn("kind", classify_kind(F.col("_name")))
        .where(F.col("kind").isNotNull() & discoverable(F.col("rel_path"), max_depth))
        .select(
            "repo_id",
            "rel_path",
            "kind",
            classify_load(F.col("_name")).alias("load"),
            *measured,
        )
    )


def path_class(rel_path: Column, max_depth: int = dims.MAX_DEPTH) -> Column:
    """``context`` | ``importable`` | ``config`` | ``other``, from the path alone.

    Used as the partition column of a laid-out snapshot
    (:func:`weighbridge.sinks.writers.write_snapshot`): the audit's scans then
    list only the partitions they need instead of reading every file's text.
    """
    is_ctx = classify_kind(basename(rel_path)).isNotNull() & discoverable(rel_path, max_depth)
    return (
        F.when(is_ctx, F.lit("context"))
        .when(rel_path.rlike(dims.IMPORTABLE_NAME), F.lit("importable"))
        .when(rel_path.rlike(dims.CONFIG_NAME), F.lit("config"))
        .otherwise(F.lit("other"))
    )
