"""weighbridge: audit the instruction files AI coding agents read, across many
repositories at once, as Spark DataFrame jobs.

The input is a snapshot table ``files(repo_id, rel_path, content)``; every
per-repository question (health grade, token budget, import tree, leaked
secrets, corpus study) is a lazy DataFrame derived from it.

    from weighbridge import audit, load_snapshot, write_reports
    a = audit(load_snapshot(spark, path), model="claude-opus")
    write_reports(a, out_dir, scanned_at="2026-07-02T00:00:00Z")
"""

from weighbridge.plans.audit import Audit, audit
from weighbridge.sinks.writers import write_reports, write_snapshot
from weighbridge.sources.readers import load_snapshot

__all__ = ["Audit", "audit", "load_snapshot", "write_reports", "write_snapshot"]
