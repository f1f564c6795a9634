"""Incremental scans: batch anti-join and a file-source stream."""

from weighbridge.streaming.incremental import incremental_scan, pending_repos

__all__ = ["incremental_scan", "pending_repos"]
