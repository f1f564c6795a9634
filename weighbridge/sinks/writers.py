"""Writers for the text sinks and the snapshot layout. Rows are dealt by
adaptive rebalancing, which sizes partitions by bytes and splits large ones, so neither
a repository nor a class of files fills one task, and the width grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, text_col: str = "json", mode: str = "overwrite") -> None:
    """Write ``text_col`` as text lines under ``path``, mostly grouped by repository."""
    out = df.select("repo_id", F.col(text_col).alias("value")).hint("rebalance", "repo_id")
    out.sortWithinPartitions("repo_id").select("value").write.mode(mode).text(path)


def write_scan_results(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Append per-repository result records (JSON lines) for a study."""
    docs.write.mode(mode).json(path)


def write_snapshot(files: DataFrame, path: str, mode: str = "error", rows_per_file: int = 200_000) -> None:
    """Lay a snapshot out for the audit: partitioned by ``path_class``, sorted by
    ``(repo_id, rel_path)`` inside each file.

    Context files, import candidates and configs then sit in their own
    partitions; the audit's scans prune the rest (usually nearly all bytes of
    a code snapshot) by directory, before any text is read.
    """
    from weighbridge.operators.classify import path_class

    laid = files.withColumn("path_class", path_class(F.col("rel_path")))
    (
        laid.hint("rebalance", "path_class", "repo_id")
        .sortWithinPartitions("repo_id", "rel_path")
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("path_class")
        .parquet(path)
    )


def write_reports(a, out_dir: str, scanned_at: str) -> dict[str, str]:
    """Everything one audit run reports, as distributed datasets under ``out_dir``.

    The batch counterpart of running health + budget with every output format on
    each repository: ``summary/`` (one JSON document per repository),
    ``findings/``, ``entries/`` and ``imports/`` (one JSON line per finding, budget entry and imported file),
    ``report/`` and ``sarif/`` (one payload and one SARIF document per repository, see :mod:`weighbridge.sinks.documents`)
    and ``results/`` (study records). Returns the paths written.
    """
    import os

    from weighbridge.sinks.documents import write_documents
    from weighbridge.sinks.json_report import entry_lines, finding_lines, import_lines, report_documents, report_lines, scan_result_documents
    from weighbridge.sinks.sarif import sarif_lines

    paths = {name: os.path.join(out_dir, name) for name in ("summary", "findings", "entries", "imports", "report", "sarif", "results")}
    write_lines(report_documents(a), paths["summary"], "json")
    write_lines(finding_lines(a.findings), paths["findings"], "json")
    write_lines(entry_lines(a.budget_entries), paths["entries"], "json")
    write_lines(import_lines(a.claims), paths["imports"], "json")
    write_documents(report_lines(a), paths["report"], mode="overwrite")
    write_documents(sarif_lines(a.findings, a.health, collation=a.path_collation), paths["sarif"], mode="overwrite")
    write_scan_results(scan_result_documents(a.scan_results(scanned_at), a.findings), paths["results"], mode="overwrite")
    return paths
