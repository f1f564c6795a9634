"""Sources: the snapshot table, repository lists, scan results, and the
fixture views derived from the given parquet tables."""

from weighbridge.sources.fixtures import files_v, mcp_v, repos_v, snapshot, tools_v, urls_v
from weighbridge.sources.readers import (
    lines_to_urls,
    load_snapshot,
    read_repo_list,
    read_scan_results,
    scan_result_schema,
)

__all__ = [
    "files_v",
    "lines_to_urls",
    "load_snapshot",
    "mcp_v",
    "read_repo_list",
    "read_scan_results",
    "repos_v",
    "scan_result_schema",
    "snapshot",
    "tools_v",
    "urls_v",
]
