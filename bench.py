"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query runs to completion into the ``noop`` sink (full execution, nothing
collected to the driver) with a new audit per query; the value is the sum over
queries. An untimed warm-up first scans the data once and audits three
literal files.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_scan",
    "q_health",
    "q_findings",
    "q_secret_scan",
    "q_import_closure",
    "q_budget_totals",
    "q_budget_rank",
    "q_token_count_bpe",
    "q_mcp_cost",
    "q_real_secret",
    "q_study_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession

    from weighbridge.plans.queries import QUERIES

    event_dir = tempfile.mkdtemp(prefix="weighbridge-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weighbridge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(int(cpus) * 2))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", event_dir)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up (not timed): one scan of the data, and a full audit of three literal
    # files (different data, so nothing it computes is reused) to start the
    # Python workers, load the tokenizer ranks and warm the JIT and codegen.
    QUERIES["q_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    from weighbridge import audit

    tiny = spark.createDataFrame(
        [("w", "CLAUDE.md", "@a.md\ntoken = abcdefgh12345678\n"), ("w", "a.md", "x"), ("w", "s/SKILL.md", "y")],
        "repo_id string, rel_path string, content string",
    )
    warm = audit(tiny, model="claude-opus")
    for df in (warm.health, warm.budget, warm.budget_ranked, warm.top_suggestions):
        df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        spark.catalog.clearCache()  # each query pays for what it reads: no audit's kept tables serve another
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name} {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "audit_headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
