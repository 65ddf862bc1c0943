"""Benchmark the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through a no-op sink; the reported time is the
median of BENCH_REPEATS runs (default 3) after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clausewise.plans import catalog  # noqa: E402
from clausewise.session import SPREAD_CONF, get_spark, load_table  # noqa: E402

HEADLINE = [
    "q1_audit",            # full audit of every document
    "p1_pii_spans",        # PII spans
    "p4_redact",           # redaction
    "r7_policy_violations",
    "d4_drift",            # template drift
    "d3_topk_l2",          # exact vector top-k
    "w_suggestions",
    "o1_audit_counters",
    "v1_evaluate_pii",
    "k3_ticket_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.conf.set(SPREAD_CONF, "true")  # the tables are single row groups: deal them over the cores
    # warm the session (JIT, Python workers) on a small read
    load_table(spark, sf_dir, "documents").limit(100).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    plans: dict[str, float] = {}
    for name in HEADLINE:
        runs, built = [], []
        for _ in range(repeats):
            t0 = time.time()
            df = catalog.QUERIES[name](spark, sf_dir)
            df._jdf.queryExecution().executedPlan()
            built.append(time.time() - t0)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
        plans[name] = round(statistics.median(built), 3)
    n_docs = load_table(spark, sf_dir, "documents").count()
    n_vec = load_table(spark, sf_dir, "embeddings").count()
    print(json.dumps({
        "metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build_and_plan_sec": plans, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "documents": n_docs, "audit_docs_per_sec": round(n_docs / times["q1_audit"], 1),
        "pii_docs_per_sec": round(n_docs / times["p1_pii_spans"], 1),
        "topk_pairs_per_sec": round(n_vec * (n_vec - 1) / times["d3_topk_l2"], 1),
    }))


if __name__ == "__main__":
    main()
