"""Sinks: SARIF documents, JSON reports, per-repository scan results, writers."""

from weighbridge.sinks.documents import read_documents, write_documents
from weighbridge.sinks.json_report import entry_lines, finding_lines, report_documents, report_lines, scan_result_documents
from weighbridge.sinks.results import ResultStore
from weighbridge.sinks.sarif import sarif_lines
from weighbridge.sinks.writers import write_lines, write_reports, write_scan_results, write_snapshot

__all__ = [
    "ResultStore",
    "entry_lines",
    "finding_lines",
    "read_documents",
    "report_documents",
    "report_lines",
    "sarif_lines",
    "scan_result_documents",
    "write_documents",
    "write_lines",
    "write_reports",
    "write_scan_results",
    "write_snapshot",
]
