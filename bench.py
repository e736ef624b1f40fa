"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores. Every
query is planned and run to a sink that keeps nothing, after one warm-up of the JVM and the Python workers by a
query that is not among them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskmill.plans import QUERIES  # noqa: E402
from riskmill.session import local_session  # noqa: E402

HEADLINE = [
    "rule_hits",
    "corpus_findings",
    "rule_hits_docs",
    "findings_merge",
    "eval_metrics",
    "tau_sweep",
    "group_split",
    "content_leakage",
    "bm25_topk",
    "dense_topk",
    "hmac_docs",
    "ledger_replay",
    "refund_limit",
    "duplicate_verdicts",
    "audit_append",
    "audit_verify",
    "scan_list",
    "finding_detail",
    "state_changes",
    "quota_window",
    "cost_rollup",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="riskmill-bench")
    run(spark, "code_units", sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
