"""Summarize the physical plans of key audit queries into PLANS.md.

    python tools/explain_plans.py [sf_dir]

The fixture snapshot is first written with ``write_snapshot`` (partitioned by
``path_class``) and read back with ``load_snapshot``, the way a cluster would
read a stored snapshot, and the audit runs with the parallelism floor off, so
the plans are the cluster-shaped ones: directory pruning, pushed filters and
narrow read schemas, join strategies, exchanges, windows, Python nodes.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCAN = re.compile(r"FileScan parquet [^\[\n]*\[([^\]]*)\][^\n]*?PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema: (struct<[^>\n]*>?)")
NODES = [
    "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
    "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
    "WindowGroupLimit", "Window ", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "ArrowEvalPython",
    "BatchEvalPython", "Generate", "InMemoryTableScan",
]


def summarize(name: str, df) -> list[str]:
    df.collect()  # run it: the adaptive plan is final (codegen stages, runtime join choices) afterwards
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = Counter()
    for node in NODES:
        counts[node.strip()] = len(re.findall(re.escape(node), plan))
    codegen = len(re.findall(r"\*\(\d+\)", plan))
    out = [f"### {name}", "", "| operator | count |", "| --- | ---: |"]
    out += [f"| {k} | {v} |" for k, v in counts.items() if v]
    out.append(f"| whole-stage codegen operators (`*(n)`) | {codegen} |")
    out.append("")
    scans = sorted(set(SCAN.findall(plan)))
    if scans:
        out += ["| scan columns | PartitionFilters | PushedFilters | ReadSchema |", "| --- | --- | --- | --- |"]
        for cols, part, pushed, schema in scans:
            clean = lambda s: re.sub(r"#\d+L?", "", s).replace("|", "\\|")[:160]
            out.append(f"| {clean(cols)} | {clean(part)} | {clean(pushed)} | `{clean(schema)}` |")
        out.append("")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from weighbridge import audit
    from weighbridge.operators.imports import extract_edges
    from weighbridge.session import local_session
    from weighbridge.sinks.writers import write_snapshot
    from weighbridge.sources.fixtures import repos_v, snapshot
    from weighbridge.sources.readers import load_snapshot

    spark = local_session(8, 16)
    spark.sparkContext.setLogLevel("ERROR")
    path = os.path.join(tempfile.mkdtemp(prefix="wb-plans-"), "snapshot")
    write_snapshot(snapshot(spark, sf), path)
    files = load_snapshot(spark, path)
    a = audit(files, repos=repos_v(spark, sf), weigher="bpe", model="claude-opus")
    lines = [
        "# Physical plans (summary)",
        "",
        "Generated by `tools/explain_plans.py` from a snapshot written with `write_snapshot` (partitioned by",
        "`path_class`) and read with `load_snapshot`; the audit runs with the parallelism floor off, i.e. the",
        "plan a cluster reading a stored snapshot gets. Counts are operators of the final adaptive plan after a run;",
        "tables written to the checkpoint folder by the closure loop and the ranking appear as plain parquet scans.",
        "",
    ]
    for name, df in [
        ("context scan", a.context),
        ("import edges (extraction + existence, before its checkpoint table)", extract_edges(a.files)),
        ("secret scan + all findings", a.findings),
        ("health", a.health),
        ("budget totals (BPE)", a.budget),
        ("budget rank (skew-safe)", a.budget_ranked),
        ("top suggestions (group-limited window)", a.top_suggestions),
        ("tool-server costs", a.mcp_costs),
    ]:
        lines += summarize(name, df)
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
